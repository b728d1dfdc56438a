"""Text normalisation as column expressions.

Everything is a built-in JVM expression (``regexp_replace``, ``trim`` with a
character set, ``regexp_count``), so it also runs unchanged on a streaming frame.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 characters Python's str.strip()/str.split() treat as
# white space, written as one regex class that Java regex and RE2 both read.
PY_SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Same class without brackets, for use inside a larger class.
PY_SPACE_BODY = PY_SPACE[1:-1]
# The same 29 characters as a plain string (for trim).
PY_SPACE_CHARS = "".join(chr(c) for lo, hi in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0),
                                                (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                                                (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
                         for c in range(lo, hi + 1))

# Built-in word tokenizer: runs of letters/digits/underscore, or one other
# non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + PY_SPACE_BODY + "]"
# What the same pattern matches in a text of ASCII characters, without Unicode classes.
ASCII_TOKEN_PATTERN = r"[A-Za-z0-9_]+|[!-/:-@\[-^`{-~\x00-\x08\x0e-\x1b\x7f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The patterns of X2, X4 and X5.
NEWLINES, SEPARATORS, SPACES = r"\n+", r"\n+|\r\n|\t|\r", " +"


# X4 and X5 as one class.
SEPARATOR_RUNS = r"[ \t\r\n]+"


def py_strip(col) -> Column:
    """Python ``str.strip()``.  Plain ``trim`` removes only U+0020; with the
    29-character set it works from both ends without scanning the text."""
    return F.trim(_c(col), F.lit(PY_SPACE_CHARS))


def collapse_newlines(col) -> Column:
    """``\\n+`` -> ``\\n`` then strip."""
    return py_strip(F.regexp_replace(_c(col), NEWLINES, "\n"))


def spaces_to_tab(col, n: int = 4) -> Column:
    """Every block of ``n`` spaces becomes one tab, then strip."""
    if n < 1:
        raise ValueError("n must be positive")
    return py_strip(F.regexp_replace(_c(col), " {%d}" % n, "\t"))


def separators_to_space(col) -> Column:
    """``\\n+``, ``\\r\\n``, ``\\t`` or ``\\r`` -> one space each, then strip."""
    return py_strip(F.regexp_replace(_c(col), SEPARATORS, " "))


def collapse_spaces(col) -> Column:
    """Runs of U+0020 -> one space, then strip."""
    return py_strip(F.regexp_replace(_c(col), SPACES, " "))


def shrink_text(col, keep_formatting: bool = False, spaces_in_tab: int = 4) -> Column:
    """The dataset-wide text shrink.

    keep_formatting: X3(X2(s)); otherwise X5(X4(s)), in one pass: the separators of X4 and the
    spaces of X5 make runs that become one space, and what is stripped between the two steps goes at
    the end as well.  Form feed, vertical tab and NBSP inside the text are left alone, as in the original rule.
    """
    if keep_formatting:
        return spaces_to_tab(collapse_newlines(col), spaces_in_tab)
    return py_strip(F.regexp_replace(_c(col), SEPARATOR_RUNS, " "))


def split_join(col) -> Column:
    """``' '.join(s.split())`` - every Unicode space run becomes one space."""
    return F.regexp_replace(py_strip(col), f"{PY_SPACE}+", " ")


def _by_script(col, f) -> Column:
    """``f(text, pattern)`` with the cheaper pattern where a text is ASCII."""
    c = _c(col)
    return F.when(F.octet_length(c) == F.char_length(c), f(c, F.lit(ASCII_TOKEN_PATTERN))).otherwise(f(c, F.lit(TOKEN_PATTERN)))


def token_count(col, tokenizer=None, tokenizer_loader=None) -> Column:
    """Tokens per text.

    ``tokenizer=None`` uses the built-in word pattern, counted by
    ``regexp_count`` without building the token array.  A callable tokenizer
    (``str -> list``) runs as an Arrow UDF; ``tokenizer_loader`` (a zero-argument
    function returning such a callable, e.g. reading a tokenizer from a path) is
    called once per Python worker process.
    """
    if tokenizer is None and tokenizer_loader is None:
        return _by_script(col, lambda c, pattern: F.regexp_count(c, pattern)).cast("int")

    @F.pandas_udf(T.IntegerType())
    def _count(s: pd.Series) -> pd.Series:
        from .workers import cached
        tok = tokenizer if tokenizer_loader is None else cached(tokenizer_loader)
        return s.map(lambda x: None if x is None else len(tok(x))).astype("Int32")

    return _count(_c(col))


def tokens(col) -> Column:
    """Token array of the built-in tokenizer (used by X11 and T2)."""
    return _by_script(col, lambda c, pattern: F.regexp_extract_all(c, pattern, 0))


def json_field(col, path: str, cast: str | None = None) -> Column:
    """Nested field of a JSON string column (``$.a.b``)."""
    out = F.get_json_object(_c(col), path)
    return out.cast(cast) if cast else out


def layout_tokens(col) -> Column:
    """Rebuild line breaks and tabs from NEW_LINE / INDENT / DEDENT markers.

    A NEW_LINE opens a line.  A line is a break, one tab for each level of depth after the
    markers in it, and its words; INDENT and DEDENT raise and lower the depth and leave no
    word.  Before the first NEW_LINE there is no break to carry the tabs: there the first word
    gives its place to it if a marker follows, and a single marker in front carries none.
    Runs of spaces become one.

    The markers become characters that no token can hold (they count as white space), the text
    is cut at the line marker, and a fold over the lines keeps the running depth."""
    line_mark, up, down = "\x1c", "\x1d", "\x1e"
    text = F.concat(F.lit(" "), split_join(col), F.lit(" "))
    for word, mark in (("new_line", line_mark), ("indent", up), ("dedent", down)):
        text = F.regexp_replace(text, f"(?i)(?<= ){word}(?= )", mark)
    # a lambda over one element names the marked text, so that it is made once
    return F.get(F.transform(F.array(text), lambda t: _laid_out(t, line_mark, up, down)), 0)


def _laid_out(text: Column, line_mark: str, up: str, down: str) -> Column:
    """The text of marked lines; the rule of ``layout_tokens``."""
    lines = F.split(text, line_mark)

    def count(part, mark):
        return F.length(part) - F.length(F.replace(part, F.lit(mark), F.lit("")))

    def depth(part):
        return count(part, up) - count(part, down)

    def words(part):
        return F.translate(part, up + down, "")

    def line_break(d):
        return F.concat(F.lit(" \n "), F.repeat(F.lit(" \t "), F.greatest(d, F.lit(0))))

    first = F.element_at(lines, 1)
    here, marked_first = count(first, up) + count(first, down), F.substring(first, 2, 1).isin(up, down)
    head = (F.when(here == 0, first)
            .when(marked_first & (here == 1), words(first))
            .when(marked_first, F.concat(line_break(depth(first)), words(first)))
            .otherwise(F.concat(line_break(depth(first)), words(F.regexp_replace(first, "^ [^ ]+", "")))))
    rest = F.aggregate(
        F.slice(lines, 2, F.size(lines)), F.struct(depth(first).alias("d"), F.lit("").alias("out")),
        lambda s, part: F.struct((s["d"] + depth(part)).alias("d"),
                                 F.concat(s["out"], line_break(s["d"] + depth(part)), words(part)).alias("out")),
        lambda s: s["out"])
    inner = F.trim(F.regexp_replace(F.concat(head, rest), " +", " "))
    # what stands for a marker at either end is joined by a space
    lead = F.substring(text, 2, 1).isin(line_mark, up, down) | (here > 0)
    tail = F.substring(text, -2, 1).isin(line_mark, up, down)
    return (F.when(text.isin("  ", f" {up} ", f" {down} "), F.lit(""))
            .otherwise(F.concat(F.when(lead, " ").otherwise(""), inner, F.when(tail, " ").otherwise(""))))
