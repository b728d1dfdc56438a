"""The column functions against plain Python string semantics."""
import re

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelbench.functions import text as X

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]
ALPHABET = st.sampled_from(SPACES + list("ab.,é\r\n") + ["INDENT", "DEDENT", "NEW_LINE", "new_line"])
TEXTS = st.lists(ALPHABET, max_size=30).map("".join)


def test_python_space_set_has_29_members():
    assert len(SPACES) == 29
    assert sorted(X.PY_SPACE_CHARS) == sorted(SPACES)


def _run(spark, texts, col_fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.o for r in df.select("i", col_fn(F.col("s")).alias("o")).orderBy("i").collect()]


def _py_x2(s):
    return re.sub(r"\n+", "\n", s).strip()


def _py_x3(s, n=4):
    return re.sub(" " * n, "\t", s).strip()


def _py_x4(s):
    return re.sub(r"\n+|\r\n|\t|\r", " ", s).strip()


def _py_x5(s):
    return re.sub(" +", " ", s).strip()


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_normalisers_match_python(spark, texts):
    cases = [
        (X.py_strip, str.strip),
        (X.collapse_newlines, _py_x2),
        (X.spaces_to_tab, _py_x3),
        (X.separators_to_space, _py_x4),
        (X.collapse_spaces, _py_x5),
        (lambda c: X.shrink_text(c, False), lambda s: _py_x5(_py_x4(s))),
        (lambda c: X.shrink_text(c, True), lambda s: _py_x3(_py_x2(s))),
        (X.split_join, lambda s: " ".join(s.split())),
    ]
    for col_fn, py in cases:
        assert _run(spark, texts, col_fn) == [py(t) for t in texts]


def test_fixed_edge_cases(spark):
    texts = ["", "   ", "a\r\n\n\rb", "\n\r\n", "\n\n\n", "   a", "    a", "     a", "        a",
             "　x ", "\x1cA\x1f", "a\x0bb\x0cc\xa0d"]
    assert _run(spark, texts, X.py_strip) == [t.strip() for t in texts]
    assert _run(spark, texts, X.spaces_to_tab) == [_py_x3(t) for t in texts]
    assert _run(spark, texts, X.split_join) == [" ".join(t.split()) for t in texts]
    # X6 leaves form feed, vertical tab and NBSP inside the text
    assert _run(spark, ["a\x0bb\x0cc\xa0d"], X.shrink_text) == ["a\x0bb\x0cc\xa0d"]


LAYOUT_CASES = {
    "": "", "x": "x", "a  b": "a b", "NEW_LINE": " \n ", "INDENT": "", "Dedent": "",
    "a NEW_LINE b": "a \n b",
    "a new_line INDENT b NEW_LINE c DEDENT NEW_LINE d": "a \n \t b \n c \n d",
    "f NEW_LINE INDENT x NEW_LINE INDENT y NEW_LINE z": "f \n \t x \n \t \t y \n \t \t z",
    "INDENT a NEW_LINE b": " a \n \t b",           # one marker in front carries no break
    "INDENT INDENT a": " \n \t \t a",
    "a DEDENT DEDENT b": " \n b",                  # the first word gives way; no tabs below depth 0
    "a INDENT": " \n \t ",
    "a DEDENT NEW_LINE INDENT b": " \n \n b",
    "a NEW_LINE": "a \n ",
    "indented NEW_LINES x": "indented NEW_LINES x",  # only whole words are markers
    "a NEW_LINE NEW_LINE INDENT b": "a \n \n \t b",
}


def test_layout_tokens(spark):
    assert _run(spark, list(LAYOUT_CASES), X.layout_tokens) == list(LAYOUT_CASES.values())
    null = spark.createDataFrame([(None,)], "s string").select(X.layout_tokens("s").alias("o")).first()
    assert null.o is None


def test_token_count_matches_regex_module(spark):
    texts = ["héllo wörld, x_1!", "", "a  b\tc", "don't stop", "数字 123 abc"]
    pat = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")
    assert _run(spark, texts, X.token_count) == [len(pat.findall(t)) for t in texts]


def test_json_field(spark):
    df = spark.createDataFrame([('{"a": {"b": 3}}',), ('{"a": 1}',)], "s string")
    assert [r[0] for r in df.select(X.json_field("s", "$.a.b", "int")).collect()] == [3, None]


def test_pluggable_tokenizer_runs_as_arrow_udf(spark):
    texts = ["a b  c", "", "x"]
    got = _run(spark, texts, lambda c: X.token_count(c, tokenizer=str.split))
    assert got == [3, 0, 1]


def test_tokenizer_loader_once_per_worker(spark):
    def load():  # e.g. read a tokenizer from a path; runs once per Python worker
        return lambda s: s.split()
    got = _run(spark, ["a b", "c d e"], lambda c: X.token_count(c, tokenizer_loader=load))
    assert got == [2, 3]
