"""Token-id files: range asymmetric numeral system (rANS) with static shared frequency tables.

*Layout.*  Documents are range-partitioned and sorted by doc_id; every partition is a shard and
writes its ids as segments of ``SEGMENT`` ids (the last one shorter).  A segment is one self-contained
binary value: a header, the frequency table that all of its blocks share, the directory
of the documents in it, and blocks of ``STEPS`` x ``LANES`` ids.  A block is coded by itself with
one state for each lane, lane l taking every LANES-th id from l on, and carries checkpoints (the
states, and the position in the block's words, every ``CHECK`` steps), the checksum of its words
and that of its ids.  So any block, and any stretch between checkpoints, can be decoded alone.
Segments are rows of a Parquet table, whose writer brings the commit protocol and any file
system that Spark reaches.

*Coding.*  64-bit states in [2^31, 2^63), 32-bit words, frequencies that sum to 2^PROB.  All blocks
of a segment are coded in step, as numpy vectors over blocks x lanes.

Defined cases: null text is empty, so the document is the end id alone; rows that share a
doc_id follow each other by text; a null doc_id sorts first and stays null; an empty table gives
no segments and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import batch, cut_lineage, id_and_text, rows_of
from .tokens import encoder, vocabulary_path

LANES, STEPS, CHECK, SEGMENT_BLOCKS = 128, 512, 128, 32
SEGMENT = LANES * STEPS * SEGMENT_BLOCKS
#: Frequencies sum to 2^PROB, so a table can hold as many different ids.
PROB = 18
MAGIC, VERSION = b"TRNS", 1
_HEAD = struct.Struct("<4sHBBHHQIIIII")
_LOW = np.uint64(1 << 31)

_SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
SEGMENT_DDL = "shard int, segment int, first long, n_ids long, data binary"
_PIECES = pa.schema([("shard", pa.int32()), ("doc_no", pa.int64()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                     ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])


def frequencies(counts: np.ndarray, prob: int = PROB) -> np.ndarray:
    """Positive integers in proportion to the positive ``counts``, with sum 2^prob."""
    total = 1 << prob
    if len(counts) > total:
        raise ValueError(f"{len(counts)} different ids do not fit into 2^{prob} slots")
    share = np.maximum(1, counts * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-share, kind="stable")
    off = total - int(share.sum())
    if off > 0:
        share[order[0]] += off
    while off < 0:  # ids rounded up to one slot take theirs from the largest
        spare = np.minimum(share[order] - 1, np.maximum(1, share[order] // 8))
        taken = np.minimum(spare, np.maximum(0, -off - (np.cumsum(spare) - spare)))
        share[order] -= taken
        off += int(taken.sum())
    return share


def _blocks(n: int) -> int:
    return -(-n // (LANES * STEPS))


def _steps(values: np.ndarray, n_blocks: int, fill: int) -> np.ndarray:
    """[step, block, lane] view of a flat sequence, filled up at its end."""
    full = np.full(n_blocks * STEPS * LANES, fill, values.dtype)
    full[:len(values)] = values
    return full.reshape(n_blocks, STEPS, LANES).transpose(1, 0, 2)


def encode(ids: np.ndarray, directory: list[tuple]) -> bytes:
    """A segment's bytes; ``directory``: (doc_id or None, doc_no, n ids here, begins here, ends here)."""
    counts = np.bincount(ids)  # as long as the vocabulary at most
    symbols = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[symbols] = np.arange(len(symbols))
    which, freq = number[ids], frequencies(counts[symbols])
    # a last, virtual symbol with all slots leaves a state as it is: it fills the last block
    freqs = np.append(freq, 1 << PROB).astype(np.uint64)
    starts = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    n_blocks = _blocks(len(ids))
    at = _steps(which, n_blocks, len(symbols))
    x = np.full((n_blocks, LANES), _LOW, np.uint64)
    words = np.zeros((STEPS, n_blocks, LANES), "<u4")
    emitted = np.zeros((STEPS, n_blocks, LANES), bool)
    saved = {}
    for t in range(STEPS - 1, -1, -1):
        f = freqs[at[t]]
        over = x >= f << np.uint64(63 - PROB)
        words[t][over], emitted[t] = x[over].astype("<u4"), over
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(PROB)) + (x - q * f) + starts[at[t]]
        if t % CHECK == 0:
            saved[t] = x
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    table = squeeze(np.diff(symbols.astype("<i8"), prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    listed = [np.array([d[0] or 0 for d in directory], "<i8"), np.array([d[1] for d in directory], "<i8"), np.array([d[2] for d in directory], "<i8"),
              np.array([(d[0] is None) | d[3] << 1 | d[4] << 2 for d in directory], "u1")]
    listing = squeeze(b"".join(a.tobytes() for a in listed))
    body, data = [], ids.astype("<u4")
    for b in range(n_blocks):
        own, sent = words[:, b][emitted[:, b]], np.cumsum(emitted[:, b].sum(axis=1))
        checks = b"".join(struct.pack("<I", int(sent[t - 1]) if t else 0) + saved[t][b].tobytes() for t in sorted(saved))
        plain = data[b * STEPS * LANES:(b + 1) * STEPS * LANES].tobytes()
        body.append(struct.pack("<III", len(own), zlib.crc32(own.tobytes()), zlib.crc32(plain)) + checks + own.tobytes())
    head = _HEAD.pack(MAGIC, VERSION, PROB, 0, LANES, STEPS, len(ids), n_blocks, len(symbols), len(directory), len(table), len(listing))
    payload = b"".join([head, table, listing, *body])
    return payload + struct.pack("<I", zlib.crc32(payload[:len(head) + len(table) + len(listing)]))


class Segment:
    """Reads a segment's bytes; ``ids()`` decodes all blocks in step, ``part()`` one stretch."""

    def __init__(self, data: bytes):
        import zstandard

        (magic, version, self.prob, _, self.lanes, self.steps, self.n, self.n_blocks, n_symbols, n_docs, table, listing) = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of token ids")
        head = _HEAD.size + table + listing
        if zlib.crc32(data[:head]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
            raise ValueError("a segment's header, table or directory is damaged")
        expand = zstandard.ZstdDecompressor().decompress
        raw = np.frombuffer(expand(data[_HEAD.size:_HEAD.size + table]), "<u4")
        self.symbols = np.cumsum(raw[:n_symbols].astype(np.int64))
        self.freqs = raw[n_symbols:].astype(np.uint64)
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.int32), self.freqs.astype(np.int64))
        raw = expand(data[_HEAD.size + table:head])
        ids, nos, sizes = (np.frombuffer(raw, "<i8", n_docs, 8 * n_docs * k) for k in range(3))
        flags = np.frombuffer(raw, "u1", n_docs, 24 * n_docs)
        self.directory = [(None if f & 1 else i, no, n, bool(f & 2), bool(f & 4)) for i, no, n, f in zip(ids.tolist(), nos.tolist(), sizes.tolist(), flags.tolist())]
        self.data, self.checks = data, -(-self.steps // CHECK)
        self.blocks, at = [], head  # (words, their crc, ids' crc, offset of the checkpoints)
        size = 4 + 8 * self.lanes
        for _ in range(self.n_blocks):
            n_words, words_crc, ids_crc = struct.unpack_from("<III", data, at)
            self.blocks.append((n_words, words_crc, ids_crc, at + 12))
            at += 12 + self.checks * size + 4 * n_words

    def _words(self, block: int) -> np.ndarray:
        n, crc, _, at = self.blocks[block]
        own = self.data[at + self.checks * (4 + 8 * self.lanes):][:4 * n]
        if zlib.crc32(own) != crc:
            raise ValueError(f"block {block} is damaged")
        return np.frombuffer(own, "<u4")

    def _checkpoint(self, block: int, k: int) -> tuple[int, np.ndarray]:
        at = self.blocks[block][3] + k * (4 + 8 * self.lanes)
        return struct.unpack_from("<I", self.data, at)[0], np.frombuffer(self.data, "<u8", self.lanes, at + 4)

    def _run(self, blocks: list[int], check: int, steps: int) -> np.ndarray:
        """[block, step, lane] symbol numbers of some blocks, from a checkpoint on."""
        found = [self._words(b) for b in blocks]
        base = np.cumsum([0, *map(len, found)])
        words = np.concatenate([*found, np.zeros(1, "<u4")]).astype(np.uint64)
        marks = [self._checkpoint(b, check) for b in blocks]
        x = np.stack([m[1] for m in marks])
        at = base[:-1] + np.array([m[0] for m in marks])
        first = (np.array(blocks) * self.steps + check * CHECK)[:, None] * self.lanes + np.arange(self.lanes)
        out = np.empty((steps, len(blocks), self.lanes), np.int32)
        low = np.uint64((1 << self.prob) - 1)
        for t in range(steps):
            slot = x & low
            s = self.slots[slot.astype(np.int64)]
            y = self.freqs[s] * (x >> np.uint64(self.prob)) + slot - self.starts[s]
            x = np.where(first + t * self.lanes < self.n, y, x)
            need = x < _LOW
            order = np.cumsum(need, axis=1)
            x = np.where(need, x << np.uint64(32) | words[np.where(need, at[:, None] + order - 1, -1)], x)
            at = at + order[:, -1]
            out[t] = s
        return out.transpose(1, 0, 2)

    def ids(self) -> np.ndarray:
        """All ids, with every block's checksum verified."""
        found = self._run(list(range(self.n_blocks)), 0, self.steps).reshape(-1)[:self.n]
        out = self.symbols[found].astype("<u4")
        size = self.steps * self.lanes
        for b, (_, _, crc, _) in enumerate(self.blocks):
            if zlib.crc32(out[b * size:(b + 1) * size].tobytes()) != crc:
                raise ValueError(f"the ids of block {b} do not have their checksum")
        return out

    def part(self, block: int, check: int) -> np.ndarray:
        """The ids between two checkpoints of one block."""
        steps = min(CHECK, self.steps - check * CHECK)
        at = (block * self.steps + check * CHECK) * self.lanes
        found = self._run([block], check, steps).reshape(-1)
        return self.symbols[found[:max(0, self.n - at)]].astype("<u4")


def write(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Segments (shard, segment, first, n_ids, data) in ascending doc_id order; write them with any sink."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        encode_text, shard = encoder(path), TaskContext.get().partitionId()
        held, size, listed, number, first, doc_no = [], 0, [], 0, 0, 0

        def flush(n):
            nonlocal held, listed, number, first
            ids = np.concatenate(held)
            done, held = ids[:n], [ids[n:]]
            row = batch(_SEGMENTS, [[shard], [number], [first], [n], [encode(done, listed)]])
            listed, number, first = [], number + 1, first + n
            return row

        for rows in batches:
            ids, ends = encode_text.batch(rows.column("text"))
            held.append(np.insert(ids.astype("<u4"), ends[1:], end_id))
            for doc_id, n in zip(rows.column("doc_id").to_pylist(), (np.diff(ends) + 1).tolist()):
                left, begins = n, True
                while left:
                    here = min(left, segment - size)
                    left, size = left - here, size + here
                    listed.append((doc_id, doc_no, here, begins, not left))
                    begins = False
                    if size == segment:
                        yield flush(segment)
                        size = 0
                doc_no += 1
        if size:
            yield flush(size)

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SEGMENT_DDL)


def crc32_combine(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings in a row, from their own and the second one's length."""
    def times(matrix, vector):
        total = 0
        for row in matrix:
            if vector & 1:
                total ^= row
            vector >>= 1
        return total

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]  # one zero byte
    while n:
        if n & 1:
            a = times(step, a)
        step = [times(step, row) for row in step]
        n >>= 1
    return a ^ b


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from its segments."""

    def run(batches):
        for rows in batches:
            for shard, number, first, data in rows_of(rows, "shard", "segment", "first", "data"):
                segment = Segment(data)
                ids, at, out = memoryview(segment.ids().tobytes()), 0, []
                for doc_id, doc_no, n, begins, ends in segment.directory:
                    out.append((shard, doc_no, number, doc_id, first + at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), begins and ends))
                    at += n
                yield batch(_PIECES, list(zip(*out)))

    def joined(pdf):
        pdf = pdf.sort_values("segment")
        crc = int(pdf["crc"].iloc[0])
        for n, more in zip(pdf["n"].iloc[1:], pdf["crc"].iloc[1:]):
            crc = crc32_combine(crc, int(more), 4 * int(n))
        return pdf.iloc[:1].assign(n=pdf["n"].sum(), crc=crc)[["shard", "doc_id", "start", "n", "crc"]]

    pieces = cut_lineage(segments.mapInArrow(run, "shard int, doc_no long, segment int, doc_id long, start long, n long, crc long, whole boolean"))
    cut = pieces.where("not whole").groupBy("shard", "doc_no").applyInPandas(joined, "shard int, doc_id long, start long, n long, crc long")
    rows = pieces.where("whole").select("shard", "doc_id", "start", "n", "crc").unionByName(cut)
    # one row for each shard, of which there are as many as the writer had partitions
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes the segments to a table in the shared folder, and reads the documents back from it."""
    return read_documents(cut_lineage(write(docs, end_id, vocabulary, segment)))
