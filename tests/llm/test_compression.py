"""Base counts against brute force, bands on made cases, and clean rows of the given table."""
import os
import random
import re
from collections import Counter

import zstandard

from labelbench.llm import compression
from labelbench.llm.tables import read

from conftest import SF01


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def _texts():
    r = random.Random(4)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(900))
    noise = " ".join(os.urandom(12).hex() if i % 2 else "".join(chr(33 + b % 90) for b in os.urandom(40)) for i in range(60))
    return {"null": None, "empty": "", "blank": " \n\t\n", "short": "a b a b a b", "prose": prose, "loop": "same words again and again\n" * 400,
            "marks": "# a | b | <c> $5\n" * 3 + "é ñ ñ é" + "\x1c", "half": prose + "\n" + "x y z " * 2000, "noise": "".join(chr(33 + b % 94) for b in os.urandom(9000)),
            "mix": noise, "lines": "a\na\n \n a\nb\r\nb\r\n\n\n", "long": prose * 30}


def test_rows(spark):
    texts = _texts()
    rows = [(i, t, 1) for i, t in enumerate(texts.values())] + [(None, "a b", 1), (0, None, 1)]
    out = compression.quality(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert len(out) == len(rows)
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    for x, (i, t, _) in zip(out, rows):
        n = brute(t)
        assert (x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (i, *n)
        assert x.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        data = (t or "").encode()
        limits = [v for k, v in compression.BANDS.items() if k <= len(data)]
        if limits:
            ratio = len(data) / len(z.compress(data))
            assert x.ratio == ratio
            if not limits[-1][0] <= ratio <= limits[-1][1]:
                assert not x.kept
        assert not (x.kept and x.base_failed)
    kept = {k: x.kept for k, x in zip(texts, out)}
    assert kept["prose"] and not kept["loop"] and not kept["noise"] and not kept["half"]


def test_chunks_decide_where_the_whole_ratio_does_not():
    z = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    prose = _texts()["prose"].encode()[:4096]
    loop = b"x y z " * 800
    ratio, share, ok = compression.verdict(prose + loop[:4096] * 2, z, chunk=4096)
    assert not ok and abs(share - 2 / 3) < 0.01


def test_empty_table(spark):
    assert compression.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_rows_stay(spark):
    """Documents marked as good quality pass unless the base rules fail them."""
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    out = compression.quality(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    n, kept = out.selectExpr("count(*)", "sum(int(kept))").first()
    assert n > 100 and kept >= 0.99 * n
