"""Vector code compression: parts of vectors as indexes into small codebooks, found through GNAT trees.

*Codes.*  Components become integers; a vector is cut into consecutive parts, and each part position has a codebook
that starts from the first vectors and is refined in rounds: every part goes to its nearest entry, an entry
moves to the floor of its parts' mean, an unused one stays.  The quantised vectors are written once; a round is one
pass over them that returns sums for each (part, entry), so only the codebooks pass through the driver.

*Search.*  A geometric near-neighbour access tree (GNAT) holds the entries of a codebook: a node has split points, the
other entries below it go to their nearest split point, and for each pair of split point and child the node stores
the smallest and largest distance from the point to the child's entries.  A batch of parts descends together: the distance to
a split point, with the nearest entry so far, rules out every child whose range lies strictly farther; ranges
and distances are rounded outwards, and what is left is compared in exact integers, ties to the lower index.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors of another length than the
first one kept (the smallest vec_id) are returned without code and error; a null vec_id is kept and starts no codebook
before all others have; rows that share a vec_id are vectors of their own, the smaller first; where a length does not divide, the first parts are
longer; with fewer vectors than entries a codebook is as small; an empty table gives no rows; other columns are
ignored.  Squares must fit into 64 bits: larger components (92,000 for parts of 8) are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Split points of a node.
DEGREE = 4
#: Widens a rounded distance by more than its relative error (conversion, root and sum).
_UP, _DOWN = 1 + 2.0 ** -49, 1 - 2.0 ** -49


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = x - point
    return np.einsum("ij,ij->i", away, away)


class Gnat:
    """Exact nearest entry of a codebook ([entry, component] integers)."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree = entries, degree
        self.root = self._node(list(range(len(entries))))

    def _node(self, members: list[int]):
        """(split points, members' least and largest distance [split, child], children), or None."""
        if not members:
            return None
        splits, x = [members[0]], self.entries[members]
        near = squared(x, self.entries[members[0]])
        while len(splits) < min(self.degree, len(members)):  # the farthest from those before
            near[[members.index(s) for s in splits]] = -1
            splits.append(members[int(np.argmax(near))])
            near = np.minimum(near, squared(x, self.entries[splits[-1]]))
        below: list[list[int]] = [[] for _ in splits]
        for e in members:
            if e not in splits:
                below[int(np.argmin(squared(self.entries[splits], self.entries[e])))].append(e)
        least, most = np.empty((2, len(splits), len(splits)))
        for i, s in enumerate(splits):
            for j, rest in enumerate(below):
                d = np.sqrt(squared(self.entries[[splits[j], *rest]], self.entries[s]).astype(np.float64))
                least[i, j], most[i, j] = d.min() * _DOWN, d.max() * _UP
        return splits, least, most, [self._node(rest) for rest in below]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of integers."""
        self.index, self.best = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        self._visit(self.root, x, np.arange(len(x)))
        return self.index, self.best

    def _visit(self, node, x: np.ndarray, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        splits, least, most, children = node
        open_ = np.ones((len(rows), len(splits)), bool)
        for i, s in enumerate(splits):
            live = np.flatnonzero(open_[:, i])
            own = rows[live]
            d2 = squared(x[own], self.entries[s])
            better = (d2 < self.best[own]) | (d2 == self.best[own]) & (s < self.index[own])
            self.best[own[better]], self.index[own[better]] = d2[better], s
            d, r = np.sqrt(d2.astype(np.float64))[:, None], np.sqrt(self.best[own].astype(np.float64))[:, None] * _UP
            open_[live] &= ~((d * _DOWN > (most[i] + r) * _UP) | (least[i] * _DOWN > (d * _UP + r) * _UP))
        for j, child in enumerate(children):
            self._visit(child, x, rows[open_[:, j]])


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a vector."""
    size, more = divmod(length, parts)
    ends = np.cumsum([0] + [size + (p < more) for p in range(parts)]).tolist()
    return list(zip(ends, ends[1:]))


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (integers) of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.coalesce(finite, F.lit(False)))
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), "label", q.cast("array<long>").alias("q"))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(len(column), length)
    if x.size and int(max(x.max(), -x.min())) * 2 >= int((2 ** 62 / max(length, 1)) ** 0.5):
        raise ValueError("components are too large for squares of 64 bits")
    return x


def _assigned(x: np.ndarray, books: list[np.ndarray]):
    """(part, its columns, index, squared distance) for each part of the rows."""
    for p, (a, b) in enumerate(bounds(x.shape[1], len(books))):
        own = np.ascontiguousarray(x[:, a:b])
        yield p, own, *Gnat(books[p]).nearest(own)


def refine(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round over all rows (of vectors of one length)."""

    def run(batches):
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column("q"), length)
            for p, own, index, _ in _assigned(x, books):
                np.add.at(sums[p], index, np.column_stack([np.ones(len(own), np.int64), own]))
        out = [(p, e, row.tolist()) for p, s in enumerate(sums) for e, row in enumerate(s) if row[0]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["part", "entry", "sums"])

    partial = rows.select("q").mapInArrow(run, "part int, entry int, sums array<long>")
    total = partial.select("part", "entry", F.posexplode("sums").alias("pos", "v")).groupBy("part", "entry", "pos").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in total.collect():  # one number for each entry and component
        found.setdefault((r.part, r.entry), {})[r.pos] = r.v
    out = [b.copy() for b in books]
    for (p, e), v in found.items():
        out[p][e] = [v[k + 1] // v[0] for k in range(books[p].shape[1])]
    return out


def _codes(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, label, code, error."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("q"), length)
            error, code = np.zeros(len(x), np.int64), np.empty((len(x), len(books)), object)
            for p, _, index, d2 in _assigned(x, books):
                error += d2
                code[:, p] = index
            text = ["".join(f"{i:02x}" for i in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return rows.select("vec_id", "label", "q").mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each vector kept."""
    kept = cut_lineage(quantise(vectors, scale))
    first = kept.select(F.size("q").alias("n")).orderBy(F.asc_nulls_last(kept.vec_id), kept.q).limit(1).collect()
    length = first[0].n if first else 0
    same = kept.where(F.size("q") == length)
    start = same.select("q").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    x = np.array([r.q for r in start], np.int64).reshape(len(start), length)
    books = [x[:, a:b] for a, b in bounds(length, parts)]
    for _ in range(rounds if len(start) else 0):
        books = refine(same, books, length)
    other = kept.where(F.size("q") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut_lineage(_codes(same, books, length).unionByName(other))
    # a null label is a group of its own
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("value"))
    sums = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    return coded.withColumn("key", key).join(sums, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes in DuckDB SQL, comparing every part with every entry; for vectors of one length that divides."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (select vec_id, part, arg_min(entry, d * {entries} + entry) entry, min(d) d from (
  select c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v))::hugeint d from comp c join book{r} b using (part, pos) group by all) group by all)""")
        if r < rounds:
            steps.append(f"""book{r + 1} as materialized (select part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, v)::bigint v from book{r} left join (
  select part, n.entry, pos, sum(v)::hugeint s, count(*)::hugeint n from comp join near{r} n using (vec_id, part) group by all) using (part, entry, pos))""")
    return f"""
with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (select vec_id, (i - 1) // (len(q) // {parts}) part, (i - 1) % (len(q) // {parts}) pos, q[i] v from (
  select vec_id, q, unnest(range(1, len(q) + 1)) i from kept)),
book0 as materialized (select part, entry, pos, v from comp join (
  select vec_id, row_number() over (order by vec_id) - 1 entry from kept qualify entry < {entries}) using (vec_id)),
{", ".join(steps)},
coded as (select vec_id, string_agg(printf('%02x', entry::int), '' order by part) code, sum(d)::bigint error from near{rounds} group by vec_id),
done as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256
from coded join kept using (vec_id), done"""
