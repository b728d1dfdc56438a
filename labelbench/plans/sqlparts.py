"""SQL text shared by several oracle queries (DuckDB dialect).

The oracle side always uses the plain textbook form (one window per class,
full joins); the Spark side uses the scalable forms.  Agreement of the two is
what the correctness gate checks.
"""

from __future__ import annotations

from ..functions.text import PY_SPACE, TOKEN_PATTERN


def sround(x: str, k: int) -> str:
    """SQL twin of Spark's ``round(round(x, 9), k)``: stabilise float noise at
    9 decimals, then round half-up on the decimal form (as Spark does)."""
    return f"CAST(round(CAST(CAST(round({x}, 9) AS VARCHAR) AS DECIMAL(38, 12)), {k}) AS DOUBLE)"


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_lit(f'^{PY_SPACE}+|{PY_SPACE}+$')}, '', 'g')"


def collapse_newlines(expr: str) -> str:
    return strip(f"regexp_replace({expr}, {sql_lit(chr(10) + '+')}, {sql_lit(chr(10))}, 'g')")


def spaces_to_tab(expr: str, n: int = 4) -> str:
    return strip(f"regexp_replace({expr}, {sql_lit(' {%d}' % n)}, {sql_lit(chr(9))}, 'g')")


def separators_to_space(expr: str) -> str:
    return strip(f"regexp_replace({expr}, {sql_lit(chr(10) + '+|' + chr(13) + chr(10) + '|' + chr(9) + '|' + chr(13))}, ' ', 'g')")


def collapse_spaces(expr: str) -> str:
    return strip(f"regexp_replace({expr}, ' +', ' ', 'g')")


def shrink_text(expr: str, keep_formatting: bool = False, n: int = 4) -> str:
    if keep_formatting:
        return spaces_to_tab(collapse_newlines(expr), n)
    return collapse_spaces(separators_to_space(expr))


def split_join(expr: str) -> str:
    return f"regexp_replace({strip(expr)}, {sql_lit(PY_SPACE + '+')}, ' ', 'g')"


def token_count(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {sql_lit(TOKEN_PATTERN)})) AS INTEGER)"


def tokens_joined(expr: str) -> str:
    return f"array_to_string(regexp_extract_all({expr}, {sql_lit(TOKEN_PATTERN)}), ' ')"


# Text with every kind of separator the normalisers handle, made from the
# provided documents (which themselves hold none of tab, CR, NBSP, double space).
NOISY_PREFIX = "  \t"
NOISY_SUFFIX = " 　\n\n"
NOISY_SENTENCE = ".\t  \r\n"
NOISY_COMMA = ",       "
NOISY_LINE = "\n\n\n        "


def noisy(expr: str) -> str:
    inner = (f"replace(replace(replace({expr}, '. ', {sql_lit(NOISY_SENTENCE)}), ', ', "
             f"{sql_lit(NOISY_COMMA)}), {sql_lit(chr(10))}, {sql_lit(NOISY_LINE)})")
    return f"({sql_lit(NOISY_PREFIX)} || {inner} || {sql_lit(NOISY_SUFFIX)})"


def seeded_key(seed, id_expr: str, *salt) -> str:
    parts = [sql_lit(str(seed)), *[sql_lit(str(s)) for s in salt], f"CAST({id_expr} AS VARCHAR)"]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def quota_ctes(prefix: str, src: str, label: str, test_size: float,
               count_expr: str = "count(*)", group_src: str | None = None) -> list[str]:
    """CTEs ``{prefix}_q(label, n_class, q_train)``: train quota per class."""
    g = group_src or f"SELECT {label} AS label, {count_expr} AS n_class FROM {src} GROUP BY {label}"
    return [
        f"{prefix}_c AS ({g})",
        f"""{prefix}_t AS (SELECT *, CAST(ceil(CAST({float(test_size)!r} AS DOUBLE) * n_all) AS BIGINT) AS n_test
  FROM (SELECT *, sum(n_class) OVER () AS n_all FROM {prefix}_c))""",
        f"""{prefix}_f AS (SELECT *, CAST((CAST(n_class AS HUGEINT) * (n_all - n_test)) // n_all AS BIGINT) AS fl,
  (CAST(n_class AS HUGEINT) * (n_all - n_test)) % n_all AS rem, n_all - n_test AS n_train FROM {prefix}_t)""",
        f"""{prefix}_q AS (SELECT label, n_class, fl + CASE WHEN r <= need THEN 1 ELSE 0 END AS q_train
  FROM (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label) AS r
        FROM {prefix}_f))""",
    ]


def stratified_ctes(prefix: str, src: str, label: str, id_col: str, test_size: float,
                    seed=42, names=("train", "test")) -> list[str]:
    """CTE ``{prefix}`` = all columns of ``src`` plus ``split``."""
    key = seeded_key(seed, id_col)
    return quota_ctes(prefix, src, label, test_size) + [
        f"""{prefix}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {key}, {id_col}) AS __rn FROM {src})""",
        f"""{prefix} AS (SELECT r.* EXCLUDE (__rn),
  CASE WHEN r.__rn <= q.q_train THEN '{names[0]}' ELSE '{names[1]}' END AS split
  FROM {prefix}_r r JOIN {prefix}_q q ON r.{label} = q.label)""",
    ]


def three_way_ctes(prefix: str, src: str, label: str, id_col: str, ratio_train=0.8,
                   ratio_valid=0.1, ratio_test=0.1, seed=42) -> list[str]:
    """CTE ``{prefix}`` = columns of ``src`` plus ``split`` in train/valid/test."""
    t1 = 1.0 - ratio_train
    t2 = ratio_test / (ratio_test + ratio_valid)
    key = seeded_key(seed, id_col)
    first = quota_ctes(prefix + "1", src, label, t1)
    second = quota_ctes(prefix + "2", None, label, t2,
                        group_src=f"SELECT label, n_class - q_train AS n_class FROM {prefix}1_q")
    return first + second + [
        f"""{prefix}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {key}, {id_col}) AS __rn FROM {src})""",
        f"""{prefix} AS (SELECT r.* EXCLUDE (__rn),
  CASE WHEN r.__rn <= a.q_train THEN 'train' WHEN r.__rn <= a.q_train + b.q_train THEN 'valid' ELSE 'test' END AS split
  FROM {prefix}_r r JOIN {prefix}1_q a ON r.{label} = a.label JOIN {prefix}2_q b ON r.{label} = b.label)""",
    ]
