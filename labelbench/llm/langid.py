"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts that are not held out; each task adds up one
count vector per language, the vectors are added in two steps and come to the driver, where the
log-probability matrix (languages x buckets) is made and broadcast.  Every language of the training rows is
learned; the matrix takes ``BUCKETS`` x 8 bytes for each, and more than ``MOST_LANGUAGES`` (262 MB) are an error.

Texts are scored in batches: their n-grams make one sparse (text, bucket) matrix of counts in
row order, which is multiplied with the log-probabilities in chunks of ``_CHUNK`` non-zero cells.

Defined cases: null text and text without a letter get ``und`` and score 0, also when nothing can
be learned (``keep_identified`` then keeps every text with a letter); repeated rows get the same prediction each; an empty table gives no rows; labels,
source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batch, rows_of

#: Buckets of the hashed n-grams, lengths of the n-grams, and additive smoothing of the counts.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Languages that a model can hold.
MOST_LANGUAGES = 1000
#: A text's evidence counts as that of this many n-grams at most, so that long texts in two
#: languages do not look certain.
EVIDENCE = 50
#: Partial sums of a language's counts that reach the driver.
_PARTS = 8
_STEP = 1 << 20
#: Non-zero cells that are multiplied at a time; n-grams of a batch of texts.
_CHUNK, _GRAMS = 1 << 14, 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str):
    """Buckets of the text's n-grams, in parts of bounded length; a space stands on both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(codes), _STEP):
        part, out = codes[at:at + _STEP + max(ORDERS) - 1], []
        for n in ORDERS:
            many = min(_STEP, len(part) - n + 1)
            if many <= 0:
                continue
            h = np.full(many, n, np.uint32)
            for k in range(n):
                h = (h ^ part[k:k + many]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h * np.uint32(0x85EBCA77) >> np.uint32(17))
        yield np.concatenate(out)


def _added(parts, keys, out_schema):
    """Adds the count vectors with one key."""
    sums: dict = {}
    for rows in parts:
        for lang, part, docs, counts in rows_of(rows, "lang", "part", "docs", "counts"):
            have = sums.setdefault((lang, part), [0, np.zeros(BUCKETS, np.int64)])
            have[0] += docs
            have[1] += np.frombuffer(counts, np.int64)
    if sums:
        yield batch(out_schema, [[k[0] for k in sums], [k[1] for k in sums], [v[0] for v in sums.values()],
                                 [v[1].tobytes() for v in sums.values()]])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    def __init__(self, languages: list[str], docs: np.ndarray, counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T)
        self.prior = np.log(docs / docs.sum())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        held, size = [], 0
        for i, text in enumerate(texts):
            if not has_letter(text):
                continue
            parts = list(grams(text))
            held.append((i, parts))
            size += sum(map(len, parts))
            if size >= _GRAMS:
                self._score(held, out)
                held, size = [], 0
        if held:
            self._score(held, out)
        return out

    def _score(self, held: list, out: list) -> None:
        sizes = np.array([sum(map(len, parts)) for _, parts in held])
        cells = np.repeat(np.arange(len(held)), sizes) * BUCKETS + np.concatenate([p for _, parts in held for p in parts])
        cells.sort()
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        counts = np.diff(np.append(first, len(cells)))
        text, bucket = np.divmod(cells[first], BUCKETS)
        total = np.zeros((len(held), len(self.languages)))
        for a in range(0, len(text), _CHUNK):
            rows, part = text[a:a + _CHUNK], counts[a:a + _CHUNK, None] * self.logp[bucket[a:a + _CHUNK]]
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            total[rows[begins]] += np.add.reduceat(part, begins)  # a row that goes on in the next chunk is added to there
        total = (total + self.prior) * np.minimum(1.0, EVIDENCE / sizes)[:, None]
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total[np.arange(len(held)), best][:, None]).sum(axis=1)
        for (i, _), k, s in zip(held, best.tolist(), score.tolist()):
            out[i] = self.languages[k], s


def fit(docs: DataFrame) -> Model:
    """Learns from all texts with a non-null lang that are not held out."""

    def count(batches):
        sums: dict = {}
        for rows in batches:
            for lang, text in rows_of(rows, "lang", "text"):
                have = sums.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
                have[0] += 1
                for idx in grams(text):
                    have[1] += np.bincount(idx, minlength=BUCKETS)
        part = TaskContext.get().partitionId() % _PARTS
        for lang, (n, counts) in sums.items():
            yield batch(_COUNTS, [[lang], [part], [n], [counts.tobytes()]])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), "text")
    if known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the matrix would take over {MOST_LANGUAGES * BUCKETS * 8 >> 20} MB in each worker")
    parts = known.mapInArrow(count, "lang string, part int, docs long, counts binary")
    sums = parts.repartition("lang", "part").mapInArrow(lambda it: _added(it, ("lang", "part"), _COUNTS),
                                                        "lang string, part int, docs long, counts binary").collect()
    languages = sorted({r.lang for r in sums})
    n, counts = np.zeros(len(languages)), np.zeros((len(languages), BUCKETS))
    for r in sums:
        n[languages.index(r.lang)] += r.docs
        counts[languages.index(r.lang)] += np.frombuffer(r.counts, np.int64)
    return Model(languages, n, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows in batches:
            found = shared.value.predict(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array([p for p, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], schema=_OUT)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a letter whose language scores at least ``least``; the others go.  Where no
    language is known to learn from, nothing can be uncertain: all rows with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for rows in batches:
            model, texts = shared.value, rows.column("text").to_pylist()
            keep = [s >= least for _, s in model.predict(texts)] if model.languages else list(map(has_letter, texts))
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
