"""Best-fit packing: documents into token sequences of one length, by bounded-space online best fit.

Each task packs its own rows.  A document's ids (plus the end id) stay whole if they fit into a
sequence; a longer document is cut into full pieces, of which only the first may be shorter, so a
document brings at most one piece that does not fill a sequence by itself.  Such pieces go, those of
``TOGETHER`` documents at a time and the longest of them first, to the open bin with the least free space
that still holds them, in Arrow batches of any size.  The
open bins are a bitset keyed by free space, so the search is a shift and a lowest set bit.  A task
keeps a fixed number of bins open; when a new one is needed beyond that, the fullest closes first.

Defined cases: null or empty text is the end id alone; repeated rows are packed again; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.  The numbers of the
sequences are unique in a result and depend on how the input is split into tasks, the pieces do not.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tables import batch, id_and_text, rows_of
from .tokens import encoder, vocabulary_path

SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Documents of a task whose short pieces are placed together.
TOGETHER = 10_000
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """The bins that still take pieces: ``bits`` has bit f set if one has f tokens free."""

    def __init__(self, capacity: int, limit: int, first_id: int = 0):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.bits, self.open = 0, 0
        self.by_free: list[deque] = [deque() for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        found = ids.popleft()
        if not ids:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            found, free = self.next_id, self.capacity
            self.next_id += 1
        left = free - length
        if left:
            if self.open == self.limit:  # the fullest closes; it may be this one
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return found, self.capacity - free
                self._take(fullest)
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, of which the first may be shorter."""
    head = n % capacity
    starts = [0] if head else []
    starts += range(head, n, capacity)
    return [(s, head if head and s == 0 else capacity) for s in starts]


def pack(docs: DataFrame, capacity: int = 1024, open_bins: int = 4096, end_id: int = 2,
         vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        encode = encoder(path)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        out: list[tuple] = []
        short: list[int] = []  # pieces that leave room in a sequence
        held = 0

        def placed():
            for i in sorted(short, key=lambda i: -out[i][3]):
                out[i] += bins.place(out[i][3])
            return batch(SCHEMA, list(zip(*out)))

        for rows in batches:
            for doc_id, text in rows_of(rows, "doc_id", "text"):
                ids = np.append(encode.ids(text).astype("<u4"), np.array([end_id], "<u4"))
                data = memoryview(ids.tobytes())
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(data[4 * start:4 * (start + length)])
                    if length < capacity:
                        short.append(len(out))
                        out.append((doc_id, k, start, length, crc))
                    else:
                        out.append((doc_id, k, start, length, crc, *bins.place(length)))
                held += 1
                if held == TOGETHER:
                    yield placed()
                    out, short, held = [], [], 0
        if out:
            yield placed()

    return id_and_text(docs).mapInArrow(run, DDL)
