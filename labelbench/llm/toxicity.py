"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

*Dictionaries.*  Both hold the same ordinary text; the toxic one holds, in front of it, the words
that are over-represented in toxic documents.  A window of ordinary words then compresses alike with
either, and a window with toxic words compresses better with the toxic dictionary.  The words
are counted on Spark over one half of a bounded sample of labelled documents; they are
ordered by support, the strongest last, where zstandard reaches them with the shortest offsets.

*Score.*  A window's gain is the bytes that the toxic dictionary saves.  Thresholds on the gain turn a
text into counts of windows; a logistic curve over them, the largest gain and the length is
calibrated on the other half of the sample, so that a score is the share of toxic documents
among those that score alike.

Defined cases: null and empty texts have one empty window, whose gain is 0; labels of held-out
documents are never read; without a toxic and an ordinary label the score is 0; a document with
several label rows counts as toxic if one says so; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import held_out
from .tables import cut_lineage, id_and_text, rows_of

#: Labelled documents that the classifier is fitted on at most (half for the dictionaries, half for
#: the calibration), those with the smallest hash of their id.
FIT_DOCUMENTS = 20_000
#: Words of a window; level of zstandard; bytes of ordinary and toxic content.
WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 8, 6, 12_000, 6_000
#: A word is over-represented if it has, per toxic document, so many times the contexts that it has
#: per ordinary one, and at least that many per toxic document (and in all).
LIFT, SUPPORT, LEAST_CONTEXTS = 8.0, 0.01, 4
#: Gains, in bytes, from which windows are counted.
THRESHOLDS = (2, 4, 6)

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of ``size`` lower-case words, with a space on both ends; the whole text."""
    words = (text or "").lower().encode().split()
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)] or [b"  "]


class Compressors:
    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL):
        self.contents, self.level, self._pair = (ordinary, toxic + ordinary), level, None

    def __getstate__(self):
        return self.contents, self.level

    def __setstate__(self, state):
        (self.contents, self.level), self._pair = state, None

    def pair(self):
        import zstandard as zs

        if self._pair is None:
            dicts = [zs.ZstdCompressionDict(c, dict_type=zs.DICT_TYPE_RAWCONTENT) for c in self.contents]
            for d in dicts:
                d.precompute_compress(level=self.level)
            self._pair = [zs.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False).compress for d in dicts]
        return self._pair

    def features(self, text: str | None) -> list[float]:
        ordinary, toxic = self.pair()
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
        return [float(min(gain.max(), 20)), *(float(np.log1p((gain >= t).sum())) for t in THRESHOLDS), float(np.log(len(gain)))]


class Classifier:
    def __init__(self, compressors: Compressors | None, weights: np.ndarray | None):
        self.compressors, self.weights = compressors, weights

    def score(self, text: str | None) -> float:
        if self.compressors is None:
            return 0.0
        z = self.weights[0] + np.dot(self.weights[1:], self.compressors.features(text))
        return float(1 / (1 + np.exp(-z)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary_words(sample: DataFrame, n_toxic: int, n_ordinary: int) -> list[str]:
    """Over-represented words, strongest last; their number is bounded by the toxic content's size.
    A word's support is the number of different words in front of it, so copies of a document
    count once.  A word longer than the toxic content cannot be part of it."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.struct(w.alias("word"), before.alias("before")))
    each = sample.select("toxic", F.explode(pairs).alias("p")).select("toxic", "p.word", "p.before")
    counts = each.where("word is not null").distinct().groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    least = max(LEAST_CONTEXTS, SUPPORT * n_toxic)
    counts = counts.where(F.octet_length("word") <= TOXIC_BYTES)
    strong = counts.where((F.col("t") >= least) & (F.col("t") / n_toxic >= LIFT * (F.col("o") + 0.5) / n_ordinary))
    return [r.word for r in strong.orderBy(F.desc("t"), "word").limit(TOXIC_BYTES // 2).collect()][::-1]


def _ordinary_text(sample: DataFrame) -> bytes:
    """One stretch of a window's words from the middle of ordinary documents, until the content is full."""
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    start = F.floor(F.size(words) / 2).cast("int") + 1
    lines = sample.where("toxic = 0").select(F.xxhash64("doc_id").alias("h"), F.concat_ws(" ", F.slice(words, start, WINDOW)).alias("line"))
    lines = lines.where((F.col("line") != "") & (F.octet_length("line") <= ORDINARY_BYTES)).orderBy("h", "line").limit(ORDINARY_BYTES // 20).collect()
    return " ".join(r.line for r in lines).encode()[:ORDINARY_BYTES]


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Classifier:
    """Learns from labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_documents)
    # at most fit_documents pairs of numbers, so the broadcast is bounded
    sample = cut_lineage(id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", (F.col("h") % 2 == 0).alias("first")))
    counts = {(r.first_half, r.toxic): r.n for r in sample.groupBy(F.col("first").alias("first_half"), "toxic").agg(F.count("*").alias("n")).collect()}
    if any((half, label) not in counts for half in (True, False) for label in (0, 1)):
        return Classifier(None, None)
    first = sample.where("first")
    toxic = " ".join(_dictionary_words(first, counts[True, 1], counts[True, 0])).encode()[-TOXIC_BYTES:]
    compressors = Compressors(_ordinary_text(first), b" " + toxic + b" ")

    def measure(batches):
        for rows in batches:
            out = [compressors.features(t) for (t,) in rows_of(rows, "text")]
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sample.where("not first").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").toPandas()
    order = np.lexsort((*np.stack(seen["x"].to_numpy()).T, seen["toxic"].to_numpy()))  # the sum's order must not depend on tasks
    x, y = np.stack(seen["x"].to_numpy())[order], seen["toxic"].to_numpy(float)[order]
    return Classifier(compressors, logistic(x, y))


def score(docs: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for rows in batches:
            found = [shared.value.score(t) for (t,) in rows_of(rows, "text")]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(found, pa.float64())], schema=_OUT)

    rows = id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    return score(docs, fit(docs, labels, fit_documents), threshold)
