"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

*Fingerprint.*  A-Z become lower case, words are runs without ASCII white space, shingles are
``shingle`` consecutive words joined by a space (repeats count; a shorter text is one shingle).
A bit is set if more than half of the shingles' XXH64 values (seed 42) set it.  A text without
words has fingerprint 0; null counts as such a text.

*Candidates.*  Let the 64 bits be eight segments on a ring and two fingerprints differ in at most
``t`` = 3 bits.  Then some segment i starts a chain whose first l segments hold at most
floor(l t / 8) differences, for every l: 0, 0, 1, 1, 1, 2, 2, 3 (the cycle lemma).  So the first two
segments of the chain are equal, and of the next three at most one is not.  Each distinct
fingerprint is therefore filed under 24 keys: a chain start, the segment of the three that may
differ, and the 32 bits of the four others.  Whoever shares a key is held against the budgets of
the whole chain, and only then against the Hamming distance.

*Groups of any size.*  Equal fingerprints are merged first.  A key's distinct fingerprints come
sorted through one streaming task, which returns a spanning forest of the links, never all
pairs.  A key with more than ``block`` of them is handed on under finer keys instead: the other 32
bits as eight nibbles, of which at least five agree, 56 choices; such a group has at most
2^12 fingerprints, by the number of bits that are left open.

Defined cases: rows with a null doc_id get a fingerprint, link to nothing and have a null
component; rows that share a doc_id are one node; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import batch, cut_lineage, id_and_text, rows_of

SEGMENTS, WIDTH = 8, 8
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("kind", pa.int32())])
#: Hashes whose bits are counted at a time.
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[shingle - 1:].tolist())),
                         dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        bits = np.unpackbits(hashes[i:i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long, one row for each row of ``docs``."""

    def run(batches):
        for rows in batches:
            ids, fps = rows.column("doc_id"), [fingerprint(t, shingle) for (t,) in rows_of(rows, "text")]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(signed)], schema=_SCHEMA)

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def budgets(distance: int, segments: int = SEGMENTS) -> list[int]:
    """Differences that the first 1, 2, ... segments of a chain may hold."""
    return [(n + 1) * distance // segments for n in range(segments)]


def _chain(start: int, length: int) -> int:
    """Mask of ``length`` segments from ``start`` on, around the ring."""
    return sum(0xFF << WIDTH * ((start + k) % SEGMENTS) for k in range(length))


def _key_masks() -> list[tuple[int, int, int]]:
    """(chain start, open segment, mask of the segments that must agree), 24 of them."""
    return [(i, j, _chain(i, 5) & ~(0xFF << WIDTH * ((i + j) % SEGMENTS))) for i in range(SEGMENTS) for j in (2, 3, 4)]


def _finer_masks(mask: int) -> list[int]:
    """The key's mask with five of the eight nibbles that it leaves open, 56 choices."""
    open_nibbles = [n for n in range(16) if not mask >> 4 * n & 0xF]
    return [mask | sum(0xF << 4 * n for n in kept) for kept in itertools.combinations(open_nibbles, 5)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def passes(x: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Which differences ``x`` keep to the budgets of the chain from ``start`` on; the last budget is
    the full distance."""
    ok = np.ones(len(x), bool)
    limits = budgets(distance)
    for length in range(1, SEGMENTS + 1):
        if length < SEGMENTS and limits[length - 1] == limits[length]:
            continue  # the longer chain has the same budget
        left = np.flatnonzero(ok)
        ok[left] = np.bitwise_count(x[left] & np.uint64(_chain(start, length))) <= limits[length - 1]
    return ok


def _forest(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among the fingerprints of one key."""
    found, todo = [], np.arange(1, len(fps))
    front = [0]
    while len(todo):
        if not front:
            front, todo = [int(todo[0])], todo[1:]
            continue
        u = front.pop()
        near = passes(fps[todo] ^ fps[u], start, distance)
        for v in todo[near].tolist():
            found.append((u, v))
            front.append(v)
        todo = todo[~near]
    return found


def _linked(keyed: DataFrame, distance: int, block: int) -> DataFrame:
    """Edges (kind -1) of rows (key, kind, fp) that share key and kind; groups beyond ``block``
    come back as rows with their kind instead, to be filed again."""

    def run(batches):
        hot, held, at = False, [], None

        def flush():
            fps = np.array(held, dtype=np.int64).view(np.uint64)
            start = at[0] // 3
            return [(held[u], held[v], 0, -1) for u, v in _forest(fps, start, distance)]

        for rows in batches:
            out: list[tuple] = []
            kinds, keys, fps = (rows.column(n).to_numpy() for n in ("kind", "key", "fp"))
            if not len(keys):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            # a group of one row inside the batch has no link; the others are taken one by one
            size = np.diff(bounds)
            keep = np.flatnonzero(size > 1)
            edge = {0, len(size) - 1}
            for g in sorted(edge.union(keep.tolist())):
                a, b = bounds[g], bounds[g + 1]
                group = (int(kinds[a]), int(keys[a]))
                if group != at:
                    if len(held) > 1 and not hot:
                        out += flush()
                    hot, held, at = False, [], group
                members = fps[a:b].tolist()
                if not hot and len(held) + len(members) > block:
                    hot = True
                    out += [(f, f, at[1], at[0]) for f in held]
                    held = []
                if hot:
                    out += [(f, f, at[1], at[0]) for f in members]
                else:
                    held += members
            if out:
                yield batch(_EDGES, list(zip(*out)))
        if len(held) > 1 and not hot and (out := flush()):
            yield batch(_EDGES, list(zip(*out)))

    grouped = keyed.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
    return grouped.mapInArrow(run, "a long, b long, key long, kind int")


def links(fps: DataFrame, distance: int = 3, block: int = 1 << 14) -> DataFrame:
    """(a, b): a spanning forest, key by key, of the pairs of distinct fingerprints at most
    ``distance`` bits apart; ``fps`` has one row per distinct fingerprint in column fp."""
    if budgets(distance)[1] != 0 or budgets(distance)[4] > 1:
        raise ValueError("the keys hold for distances up to 3 bits")
    masks = _key_masks()
    filed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for k, (_, _, m) in enumerate(masks)])).alias("x"))
    first = cut_lineage(_linked(filed.select("fp", "x.kind", "x.key"), distance, block))
    hot = first.where("kind >= 0").select(F.col("a").alias("fp"), "kind")
    finer = F.element_at(F.array(*[F.array(*[F.lit(_signed(f)) for f in _finer_masks(m)]) for _, _, m in masks]), F.col("kind") + 1)
    refiled = hot.select("fp", "kind", F.posexplode(finer).alias("choice", "mask"))
    refiled = refiled.select("fp", F.col("kind"), F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    second = _linked(refiled, distance, 1 << 62)
    return first.where("kind < 0").select("a", "b").union(second.where("kind < 0").select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, block: int = 1 << 14) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that can be reached
    over links of at most ``distance`` differing bits, the row's own included."""
    rows = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = links(distinct.select("fp"), distance, block)
    a = distinct.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))
    b = distinct.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    # rows with one doc_id are one node, whichever fingerprints they have
    versions = rows.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi and doc_id is not null")
    same = rows.join(versions.select("doc_id"), "doc_id", "left_semi").join(distinct, "fp").select("doc_id", "rep")
    edges = pairs.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(same)
    found = components(edges)
    reached = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
    out = rows.join(reached, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, one row for each; rows with a
    null doc_id stay, since nothing says which group they belong to."""
    heads = near_duplicates(docs, shingle, distance).where("doc_id = component_id").select("doc_id").distinct()
    # the smallest version of an id, by an aggregate that is combined before the shuffle; columns without an order come along
    def ordered(t):
        if isinstance(t, T.ArrayType):
            return ordered(t.elementType)
        if isinstance(t, T.StructType):
            return all(ordered(f.dataType) for f in t)
        return not isinstance(t, (T.MapType, T.VariantType))

    at = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema if f.name != "doc_id" and ordered(f.dataType)])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, at).alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))
