"""Quality rules on compressibility, beside plain counts of words, symbols and repeats.

zstandard's ratio (bytes before / bytes after) of a whole text and of its fixed chunks is held
against a band that depends on the length: a ratio above the band means repetition, one below it
means text that does not compress (keys, encoded data, noise).  A text fails if its whole ratio
is outside the band or if more than ``most`` of its bytes lie in chunks that are.

Defined cases: null counts as empty text; a text under the smallest band has no verdict of its
own (the base rules decide); repeated rows and null ids are kept as they are; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import id_and_text, rows_of

#: Least length in bytes -> (lowest, highest) ratio of zstandard level 3.  Short texts compress
#: less, so both limits rise with the length.
BANDS = {128: (0.90, 3.0), 256: (1.00, 3.5), 512: (1.10, 4.0), 1024: (1.20, 5.0), 2048: (1.30, 6.0),
         4096: (1.40, 7.0), 8192: (1.50, 8.0), 32768: (1.50, 10.0)}
LEVEL = 3
CHUNK = 4096

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                  ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
                  ("ratio", pa.float64()), ("bad_chunk_share", pa.float64())])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, ratio double, bad_chunk_share double")


def band(n: int, bands: dict = BANDS) -> tuple[float, float] | None:
    """The limits for ``n`` bytes; None below the smallest band."""
    fits = [least for least in bands if least <= n]
    return bands[max(fits)] if fits else None


def _outside(data, compress, bands) -> tuple[float | None, bool]:
    limits = band(len(data), bands)
    if limits is None:
        return None, False
    ratio = len(data) / len(compress(data))
    return ratio, not limits[0] <= ratio <= limits[1]


def verdict(data: bytes, compress, bands: dict = BANDS, chunk: int = CHUNK, most: float = 0.5) -> tuple[float | None, float, bool]:
    """(whole ratio, share of bytes in chunks outside their band, passes)."""
    ratio, out = _outside(data, compress, bands)
    view, bad = memoryview(data), 0
    if len(data) > chunk:
        for at in range(0, len(data), chunk):
            part = view[at:at + chunk]
            bad += len(part) * _outside(part, compress, bands)[1]
    share = bad / len(data) if data else 0.0
    return ratio, share, not out and share <= most


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + n] |= again
    return int(covered.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    spaces = len(data) - sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - spaces, sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
            len(lines) - len(set(lines)), repeat_words(words))


def quality(docs: DataFrame, bands: dict = BANDS, chunk: int = CHUNK, most: float = 0.5, level: int = LEVEL) -> DataFrame:
    """The base counts, base_failed, kept, and the method's own figures, one row for each row of ``docs``."""

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        for rows in batches:
            out = []
            for (text,) in rows_of(rows, "text"):
                data = (text or "").encode()
                counts = base_counts(text or "", data)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                ratio, share, passes = verdict(data, compress, bands, chunk, most)
                out.append((*counts, failed, passes and not failed, ratio, share))
            columns = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:]))], schema=_OUT)

    return id_and_text(docs).mapInArrow(run, DDL)
