"""Byte-level BPE over whole texts: ids with character offsets, and back to the bytes.

*Vocabulary.*  A rank file gives every token's bytes and its rank, which is its id.  The ``tokenizers`` library
wants characters and merges instead: bytes are shown as printable characters by the byte table, and each
way to build a token from two others is a merge, in the order of the token's rank.

*Encoding.*  Each Arrow batch is split by the pattern (the ``regex`` package, whose character classes are those
of the rank file's own library; the ``tokenizers`` library's engine has an older Unicode), and its distinct
pieces that are not in the bounded memo go, shown as characters, to the library's model.  Merges of one token are of equal rank,
so the leftmost comes first; the library orders them by their place in the list.  That can differ only where a token of three
bytes or more may stand twice in a piece, so the pieces that repeat three bytes are merged once more by rank.

*Offsets.*  ``starts`` has the character in which each token's first byte lies; tokens that divide one
character share it.

*Decoding.*  Token strings go back to bytes by the reversed byte table.  Text is decoded in slices of the ids, and
the bytes of a character that a slice cuts wait for the next one; bytes that make no character become U+FFFD.

Defined cases: null and empty texts have no ids; null ids decode to nothing; an id outside the vocabulary is an
error; a null doc_id stays null; repeated rows are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text, rows_of

#: Rank file of the public byte-level BPE; a parameter of every function here.
RANKS = "byte_bpe_50k.tiktoken"
#: Characters of the texts that are split at a time, ids that are decoded at a time, characters of all pieces in the memo,
#: and ids of a slice of one text.
GROUP_CHARS, GROUP_IDS, MEMO_CHARS, SLICE = 1_000_000, 500_000, 4_000_000, 65_536

ENCODED = "doc_id long, ids array<int>, starts array<int>"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> list[str]:
    """The character that shows each byte: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by the rank rule itself: the pair of lowest rank first, of equals the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    alive = [True] * n
    heap: list[tuple] = []

    def offer(i):
        j = ends[i]
        if j < n and (rank := ranks.get(piece[i:ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, ends[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not (alive[i] and alive[j] and ends[i] == j and ends[j] == end):
            continue
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]


def _repeats(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For pieces that stand in ``data`` one behind the other: does a sequence of three bytes come twice?"""
    piece = np.repeat(np.arange(len(sizes)), sizes)
    wide = data.astype(np.int64)
    three = (piece[:-2] << 24 | wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[piece[:-2] == piece[2:]]
    three.sort()
    out = np.zeros(len(sizes), bool)
    out[three[1:][np.diff(three) == 0] >> 24] = True
    return out


class Codec:
    """The library's tokenizer for a rank file, and the bytes of its tokens."""

    def __init__(self, path: str, pattern: str | None = None, memo_chars: int = MEMO_CHARS):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ranks, shown = read_ranks(path), byte_table()
        show = lambda token: "".join(map(shown.__getitem__, token))
        merges = [(show(t[:k]), show(t[k:])) for t in sorted(self.ranks, key=self.ranks.get)
                  for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        vocabulary = {show(t): rank for t, rank in self.ranks.items()}
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        byte_of = {c: b for b, c in enumerate(shown)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, token)) for token, i in self.library.get_vocab().items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.sizes[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.show = {b: c for b, c in enumerate(shown) if chr(b) != c}
        self.most = memo_chars
        self._forget()

    def _forget(self) -> None:
        """The memo is empty: the number of each piece, and by it where its ids lie, how many, and its characters."""
        self.memo: dict[str, int] = {}
        self.begin, self.counts, self.chars, self.ids, self.starts = (np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32))

    def learn(self, pieces: set[str]) -> None:
        """Ids and starts of new pieces into the memo."""
        if self.chars.sum() > self.most:
            self._forget()
        new = [p for p in pieces if p not in self.memo]
        if not new:
            return
        data = "".join(new).encode()
        chars = np.fromiter(map(len, new), np.int64, len(new))
        raw = np.frombuffer(data, np.uint8)
        first = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # the byte at which each character begins
        ends = first[np.cumsum(chars)]
        begins = np.append(0, ends[:-1])
        shown, tokenize = data.decode("latin-1").translate(self.show), self.library.model.tokenize
        lists = [[t.id for t in tokenize(shown[a:b])] for a, b in zip(begins.tolist(), ends.tolist())]
        for k in np.flatnonzero(_repeats(raw, ends - begins)).tolist():
            lists[k] = merge_by_rank(data[begins[k]:ends[k]], self.ranks)
        # a token begins where those before it end; places in bytes become places in characters
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, counts.sum())
        size, char = self.sizes[ids], np.cumsum(raw & 0xC0 != 0x80) - 1
        starts = char[np.cumsum(size) - size] - np.repeat(char[begins], counts)
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.begin = np.append(self.begin, np.cumsum(counts) - counts + len(self.ids))
        self.counts, self.chars = np.append(self.counts, counts), np.append(self.chars, chars)
        self.ids, self.starts = np.append(self.ids, ids), np.append(self.starts, starts.astype(np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and starts of the texts one behind the other, and where each text's begin and the last one's end."""
        split = [self.split(t) for t in texts]
        pieces = list(itertools.chain.from_iterable(split))
        self.learn(set(pieces))
        slots = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        counts, chars = self.counts[slots], np.cumsum(np.append(0, self.chars[slots]))
        upto = np.cumsum(np.append(0, counts))
        at = np.arange(upto[-1]) + np.repeat(self.begin[slots] - upto[:-1], counts)
        ends = np.cumsum([0, *map(len, split)])  # of the texts, in pieces
        before = np.repeat(chars[ends[:-1]], np.diff(ends))  # characters of the texts before a piece's own
        return self.ids[at], self.starts[at] + np.repeat(chars[:-1] - before, counts).astype(np.int32), upto[ends]

    def data(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def text(self, ids, size: int = SLICE) -> str:
        """The text of the ids, slice by slice; a character cut by a slice's end is completed by the next."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [reader.decode(self.data(ids[k:k + size])) for k in range(0, len(ids), size)]
        return "".join(parts) + reader.decode(b"", final=True)


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    """One codec per Python worker, rank file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _groups(pairs, most: int):
    """Lists of (doc_id, text) with about ``most`` characters each."""
    group, size = [], 0
    for doc_id, text in pairs:
        group.append((doc_id, text or ""))
        size += len(group[-1][1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, starts: the ids of each whole text, and the character in which each begins."""
    path = ranks or ranks_path()

    def run(batches):
        own = codec(path, pattern)
        for rows in batches:
            for group in _groups(rows_of(rows, "doc_id", "text"), GROUP_CHARS):
                ids, starts, ends = own.encode([t for _, t in group])
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids)),
                                                  pa.ListArray.from_arrays(ends, pa.array(starts))], names=["doc_id", "ids", "starts"])

    return id_and_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None, pattern: str | None = None, text: bool = True) -> DataFrame:
    """The rows with ``data``, the bytes of their ids, and with ``text``, the characters these make, in place of the ids."""
    path = ranks or ranks_path()
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c not in (ids, "data", "text")])
    new = {"data": "binary", "text": "string"} if text else {"data": "binary"}
    schema = kept.withColumns({c: F.lit(None).cast(t) for c, t in new.items()}).schema
    names = schema.names

    def run(batches):
        own = codec(path, pattern)
        for rows in batches:
            column, others = rows.column(0), rows.columns[1:]
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(column):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP_IDS, "right")))
                part = column.slice(start, end - start)
                flat, at = part.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.fill_null(pc.list_value_length(part), 0).to_pylist()])
                lists = [flat[a:b].tolist() for a, b in zip(at, at[1:])]
                made = [pa.array(map(own.data, lists), pa.binary())] + ([pa.array(map(own.text, lists), pa.string())] if text else [])
                yield pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in others] + made, names=names)
                start = end

    return encoded.select(F.col(f"`{ids}`").cast("array<int>").alias(ids), *kept.columns).mapInArrow(run, schema)


def report(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_inside (tokens that begin inside a character) per document."""
    found = encode(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        (F.size("starts") - F.size(F.array_distinct("starts"))).cast("long").alias("n_inside"), "ids")
    back = decode(found, ranks=ranks, pattern=pattern, text=False)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"), "n_inside")
