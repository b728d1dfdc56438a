"""Substring deduplication: repeated word windows, by suffix automata of reference shards.

A window of ``size`` consecutive words goes if the same words also start earlier (at a smaller
doc_id, or earlier in the same document).  An automaton of the whole corpus does not fit a task, and
broadcasting one shard after the other makes the work grow with the square of the corpus, so
the shards are cut by content, and every document meets only those that can match:

1. *Anchors.*  A window's anchor is its leftmost smallest hash of ``gram`` words.  Equal windows have
   equal anchors at equal places, and the windows of one anchor are consecutive: its context.
   A document leaves about one row for seven words.
2. *Whole contexts.*  A context that came before, word for word (hash of the words, and of the anchor's
   place), is removed with all of its windows; each mapper finds those inside its own rows
   first, so that a passage in a third of all documents leaves it once.  An anchor whose contexts
   differ (a passage's ends, edited copies) stays open, with one row for each different context.
3. *Shards.*  The words of open contexts are routed by anchor.  Per anchor, in the order of (doc_id, place),
   a context streams through the suffix automaton of those before it; where its matching
   statistics reach ``size``, the window ends there and goes.  Then the context joins the automaton.  An
   anchor with more than ``most`` different contexts is routed window by window instead, by the
   hash of the window's words, so no automaton grows beyond ``most`` contexts.
4. *Removal.*  The spans of a document are joined to its text.

Defined cases: null text has no words; null doc_ids come before all others and count as one
document; rows that share a doc_id never remove each other's windows at the same place; repeated
rows get the same result each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import batch, cut_lineage, rows_of

#: Words of a window, words that an anchor's hash spans, different contexts of one automaton.
SIZE, GRAM, MOST = 20, 8, 2048
#: Rows that a mapper sorts at a time.
_CHUNK = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_NULL_ID = -(1 << 63)

_ROWS = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("d", pa.int64()), ("v", pa.int64()), ("at", pa.int64()), ("dup", pa.bool_())])
_OPEN = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("v", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary())])
_SPANS = pa.schema([("d", pa.int64()), ("v", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only the six ASCII white-space characters split


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1, at least, of the contexts' base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_B, _B_INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, base))), dtype=np.uint64)
    return _POWERS


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo to hi - 1, alike wherever they stand."""
    power, inverse = _powers(len(h) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:len(h)], dtype=np.uint64)))
    return (sums[hi] - sums[lo]) * inverse[lo]


def contexts(words: list[bytes], size: int = SIZE, gram: int = GRAM):
    """(anchor hash, context hash, anchor's place, first and last window) of a document, as arrays."""
    n, wide = len(words), size - gram + 1
    if n < size:
        return None
    h = _hashes(words)
    g = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        g = g * _A + h[k:k + len(g)]
    g = _mixed(g)
    owner = np.lib.stride_tricks.sliding_window_view(g, wide).argmin(axis=1) + np.arange(n - size + 1)
    lo = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    hi = np.append(lo[1:], len(owner)) - 1
    pos = owner[lo]
    ctx = _spans_hash(h, lo, hi + size) + _mixed(((pos - lo) * 256 + hi - lo + 1).astype(np.uint64))
    return g[pos], _mixed(ctx), pos, lo, hi


def _split(at):
    """(place, first window, last window) from the packed column."""
    pos = at >> 16
    lo = pos - (at >> 8 & 255)
    return pos, lo, lo + (at & 255)


class Automaton:
    """Suffix automaton of several word sequences, built one after the other."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length, link, after):
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p, q, word):
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # an earlier sequence has it
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)

    def matches(self, words):
        """Matching statistics: for each word the length of the longest match that ends there."""
        state, length, after, link = 0, 0, self.next, self.link
        for word in words:
            while state and word not in after[state]:
                state = link[state]
                length = self.length[state]
            if word in after[state]:
                state, length = after[state][word], length + 1
            yield length


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents under (d, v): id, and for ids with several texts the hash of the text, which keeps them apart (else 0,
    which takes no room in the shuffles)."""
    keyed = docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = keyed.select("d", text.alias("h")).groupBy("d").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    several = cut_lineage(several.select("d", F.lit(True).alias("several")))
    if several.isEmpty():
        return keyed.withColumn("v", F.lit(0).cast("long"))
    return keyed.join(several, "d", "left").withColumn("v", F.when(F.col("several"), text).otherwise(F.lit(0).cast("long"))).drop("several")


def _context_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    def chunk(held):
        anchor, ctx, d, v, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, d, ctx, anchor))
        anchor, ctx, d, v, at = (c[order] for c in (anchor, ctx, d, v, at))
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        dup = (d != d[first]) | (at != at[first])
        spread = _mixed(d.view(np.uint64) * _A + at.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.where(dup, spread, anchor).view(np.int64), ctx.view(np.int64), d, v, at, dup)], schema=_ROWS)

    def run(batches):
        held, size_held = [], 0
        for rows in batches:
            for d, v, text in rows_of(rows, "d", "v", "text"):
                found = contexts(words_of(text), size, gram)
                if found is None:
                    continue
                anchor, ctx, pos, lo, hi = found
                n = len(pos)
                held.append((anchor, ctx, np.full(n, d), np.full(n, v), pos << 16 | (pos - lo) << 8 | hi - lo))
                size_held += n
                if size_held >= _CHUNK:
                    yield chunk(held)
                    held, size_held = [], 0
        if held:
            yield chunk(held)

    return docs.select("d", "v", "text").mapInArrow(run, "anchor long, ctx long, d long, v long, at long, dup boolean")


def _judged(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows that go, open ones: the first of every context of an anchor that has several).

    The rows of a context are ranked by themselves and an anchor's contexts are counted before they are brought
    together, so an anchor with any number of contexts takes no task's memory."""
    same = Window.partitionBy("anchor", "ctx", "dup").orderBy("d", "at")
    ranked = rows.withColumns({"gone": F.col("dup") | (F.rank().over(same) > 1), "leads": ~F.col("dup") & (F.row_number().over(same) == 1)})
    ranked = cut_lineage(ranked.select("anchor", "d", "v", "at", "gone", "leads"))
    several = ranked.where("leads").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    open_ = ranked.where("not gone").join(several, "anchor").select("anchor", "d", "v", "at", (F.col("n") > most).alias("many"))
    return ranked.where("gone").select("d", "v", "at"), open_


def _open_contexts(docs: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """The words of open contexts, under their anchor, or window by window under the window's hash.  All columns of ``docs``
    go to the join, as they do where the spans come back to the texts, so that one shuffle of them serves both."""

    def run(batches):
        seen: dict = {}  # hashes of windows that this task has sent on: the first place
        for rows in batches:
            out = []
            for d, v, text, todo in rows_of(rows, "d", "v", "text", "todo"):
                words = words_of(text)
                h = _hashes(words) if any(t["many"] for t in todo) else None
                for t in todo:
                    pos, lo, hi = _split(t["at"])
                    if not t["many"]:
                        out.append((t["anchor"], d, v, pos, lo, hi, b" ".join(words[lo:hi + size])))
                        continue
                    starts = np.arange(lo, hi + 1)
                    for s, key in zip(starts.tolist(), _mixed(_spans_hash(h, starts, starts + size)).view(np.int64).tolist()):
                        place = seen.setdefault(key, (d, s))
                        gone = place < (d, s)  # known here: no words needed, and spread over the tasks
                        out.append((hash((d, s)) if gone else key, d, v, s, s, s, None if gone else b" ".join(words[s:s + size])))
                if len(seen) > 1 << 18:
                    seen.clear()
            if out:
                yield batch(_OPEN, list(zip(*out)))

    todo = open_.groupBy("d", "v").agg(F.collect_list(F.struct("at", "anchor", "many")).alias("todo"))
    return docs.join(todo, ["d", "v"]).mapInArrow(run, "key long, d long, v long, pos long, lo long, hi long, words binary")


def _matched(contexts_: DataFrame, size: int) -> DataFrame:
    """Spans (d, v, lo, hi) of windows whose words an earlier context of the same key has."""

    def run(batches):
        key = shard = None
        for rows in batches:
            out = []
            for k, d, v, pos, lo, hi, words in rows_of(rows, "key", "d", "v", "pos", "lo", "hi", "words"):
                if words is None:
                    out.append((d, v, lo, hi))
                    continue
                if k != key:
                    key, shard = k, {"automaton": Automaton(), "waiting": [], "at": None}
                own = words.split(b" ")
                # Equal windows lie alike around their anchors, so those of an anchor that stands earlier start earlier.
                # Contexts whose anchors stand at one place (versions of a document) do not see each other.
                if shard["at"] != (d, pos):
                    for w in shard["waiting"]:
                        shard["automaton"].add(w)
                    shard["waiting"], shard["at"] = [], (d, pos)
                begin = None
                for e, length in enumerate(shard["automaton"].matches(own)):
                    if length >= size:
                        begin = lo + e - size + 1 if begin is None else begin
                        end = lo + e - size + 1
                    elif begin is not None:
                        out.append((d, v, begin, end))
                        begin = None
                if begin is not None:
                    out.append((d, v, begin, end))
                shard["waiting"].append(own)
            if out:
                yield batch(_SPANS, list(zip(*out)))

    ordered = contexts_.repartition("key").sortWithinPartitions("key", "d", "pos")
    return ordered.mapInArrow(run, "d long, v long, lo long, hi long")


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(d, v, spans) of documents that lose words: the first and last window of every span."""
    if not gram < size < 256:
        raise ValueError("a window has fewer than 256 words, and more than an anchor")
    gone, open_ = _judged(_context_rows(docs, size, gram), most)
    at = F.col("at")
    lo = F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(255)
    gone = gone.select("d", "v", lo.alias("lo"), (lo + at.bitwiseAND(255)).alias("hi"))
    spans = gone.unionByName(_matched(_open_contexts(docs, open_, size), size))
    return spans.groupBy("d", "v").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _kept(words: list[bytes], spans: list | None, size: int) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] + size for s in spans], -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[i] for i in keep.tolist()]


def report(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for rows in batches:
            out = []
            for doc_id, text, spans in rows_of(rows, "doc_id", "text", "spans"):
                words = words_of(text)
                kept = _kept(words, spans, size)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield batch(schema, list(zip(*out)) or [[]] * 4)

    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("d", "v", "text")
    joined = keyed.join(repeated_spans(keyed, size, gram, most), ["d", "v"], "left")
    doc_id = F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id")
    return joined.select(doc_id, "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``docs`` without the repeated windows: a text that loses words is what stays of it, joined by
    spaces (n_chars follows, where there is such a column); one that loses all of them goes."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"
    keyed = _keyed(renamed.withColumn("doc_id", F.col(f"c{names.index('doc_id')}")).withColumn("text", F.col(text))).drop("doc_id", text)
    joined = keyed.join(repeated_spans(keyed, size, gram, most), ["d", "v"], "left").drop("d", "v")

    def run(batches):
        for rows in batches:
            texts, there = [], []
            for t, found in rows_of(rows, "text", "spans"):
                kept = _kept(words_of(t), found, size) if found else None
                texts.append(t if kept is None else b" ".join(kept).decode())
                there.append(kept is None or bool(kept))
            out = rows.drop_columns(["spans"]).set_column(rows.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string()))
            yield out.filter(pa.array(there, pa.bool_()))

    out = joined.mapInArrow(run, joined.drop("spans").schema)
    columns = {c: F.col("text" if f"c{i}" == text else f"c{i}") for i, c in enumerate(names)}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in names])
