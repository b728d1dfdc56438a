"""Ids against the tiktoken library, offsets and decoding against the bytes."""
import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import bytebpe
from labelbench.llm.tables import read

from conftest import SF001

CODEC = bytebpe.Codec(bytebpe.ranks_path(), memo_chars=400)
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
CASES = ["", " ", "\n", "a", "a  b\n\n c", "don't I'll it's", "======== ---- aaaaaaaaaaaaa banana bananana", "<|endoftext|> x", "naïve 日本語 テキスト 🙂🙂👩‍👩‍👧",
         "Ᲊ՘x 12½٣ \x85  　z", "ȩ́ ok", "\U0001fae8\U000e0041", " " * 50 + "x", "\x00\x1c\x7f", "ab" * 300]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def check(text):
    ids, starts, ends = CODEC.encode([text])
    assert ends.tolist() == [0, len(ids)]
    want = TRUTH.encode_ordinary(text)
    assert ids.tolist() == want, repr(text)
    first = [k for k, c in enumerate(text) for _ in c.encode()]
    at, places = 0, []
    for token in want:
        places.append(first[at])
        at += len(TRUTH.decode_single_token_bytes(token))
    assert starts.tolist() == places, repr(text)
    assert CODEC.data(ids.tolist()) == text.encode()
    for size in (1, 2, 3, 1000):
        assert CODEC.text(ids.tolist(), size) == text


def test_cases():
    for text in CASES * 2:
        check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from(list("ab =-\n'st1é日🙂")), max_size=80))
def test_random_texts(text):
    check(text)


def test_several_texts():
    ids, starts, ends = CODEC.encode(CASES)
    for k, text in enumerate(CASES):
        own = CODEC.encode([text])
        assert ids[ends[k]:ends[k + 1]].tolist() == own[0].tolist() and starts[ends[k]:ends[k + 1]].tolist() == own[1].tolist()


def test_merge_by_rank():
    r = random.Random(3)
    tokens = list(CODEC.ranks)
    for _ in range(3000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else bytes(r.choice(b"ana =") for _ in range(r.randint(1, 40)))
        assert bytebpe.merge_by_rank(piece, CODEC.ranks) == TRUTH._encode_single_piece(piece)


def test_part_of_a_character():
    ids = TRUTH.encode_ordinary("🙂")
    assert len(ids) > 1 and CODEC.text(ids[:1]) == "�" and CODEC.text([]) == ""


def test_rows(spark):
    texts = [*CASES, None, "word " * 60_000, "x" * 200_000]
    rows = [(i, t, 7, "y") for i, t in enumerate(texts)] + [(None, "a b", None, None), (0, "again", 1, "z"), (0, "again", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, data string")
    out = bytebpe.report(docs).collect()
    want = []
    for i, t, _, _ in rows:
        ids = TRUTH.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    assert [tuple(x)[:4] for x in out] == want
    back = bytebpe.decode(bytebpe.encode(docs).withColumnRenamed("doc_id", "data")).collect()  # a clashing name is replaced
    assert [x.text for x in back] == [t or "" for _, t, _, _ in rows]


def test_null_ids_and_unknown_ids(spark):
    encoded = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert [bytes(x.data) for x in bytebpe.decode(encoded).collect()] == [b"", b"", CODEC.data([0, 1])]
    with pytest.raises(Exception, match="KeyError"):
        bytebpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_empty_table(spark):
    assert bytebpe.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_table(spark):
    docs = read(spark, SF001, "documents")
    want = {r.doc_id: (sha(" ".join(map(str, TRUTH.encode_ordinary(r.text or "")))), sha(r.text or "")) for r in docs.collect()}
    out = bytebpe.report(docs).collect()
    assert {x.doc_id: (x.ids_sha256, x.decoded_sha256) for x in out} == want and len(out) == len(want)
