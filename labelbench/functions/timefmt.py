"""Time and number formatting columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_run_time(col) -> Column:
    """``YYYY-mm-dd HH:MM:SS[.f][+tz]`` -> timestamp; fraction and zone are cut off."""
    s = F.substring_index(F.substring_index(_c(col), "+", 1), ".", 1)
    # zone-free: the result does not depend on the session time zone (no DST shifts)
    return F.to_timestamp_ntz(s, F.lit("yyyy-MM-dd HH:mm:ss"))


def duration_seconds(start, end, compat: bool = False) -> Column:
    """End - start in whole seconds.

    ``compat=True`` repeats the original day-of-month arithmetic (wrong across
    a month end)."""
    a, b = parse_run_time(start), parse_run_time(end)
    if not compat:
        return F.timestamp_diff("SECOND", a, b).cast("long")

    def secs(t):
        return (F.dayofmonth(t) * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")
    return secs(b) - secs(a)


def hms(seconds) -> Column:
    """Whole seconds -> ``h:mm:ss`` (hours unpadded); from 24 h on, and for
    negative durations, Python's ``N day[s], h:mm:ss``."""
    s = _c(seconds).cast("long")
    days = F.floor(s / 86400)
    rest = s - days * 86400
    core = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"),
                           F.floor((rest % 3600) / 60).cast("long"), (rest % 60).cast("long"))
    # as Python's timedelta: "1 day, ", "2 days, ", "-1 day, " (negative durations borrow a day)
    prefix = (F.when(days == 0, F.lit(""))
              .when(F.abs(days) == 1, F.concat(days.cast("long").cast("string"), F.lit(" day, ")))
              .otherwise(F.concat(days.cast("long").cast("string"), F.lit(" days, "))))
    return F.concat(prefix, core)


def hms_to_seconds(col) -> Column:
    """X13 back: ``h:mm:ss`` (optionally after ``N day[s], ``) -> seconds."""
    c = _c(col)
    day_re = r"^(-?\d+) days?, "
    days = F.when(c.rlike(day_re), F.regexp_extract(c, day_re, 1).cast("long")).otherwise(F.lit(0).cast("long"))
    parts = F.split(F.regexp_replace(c, day_re, ""), ":")
    return (days * 86400 + F.get(parts, 0).cast("long") * 3600 + F.get(parts, 1).cast("long") * 60
            + F.get(parts, 2).cast("long"))


def half_even(col, scale: int = 0) -> Column:
    """numpy/pandas rounding (half to even)."""
    return F.bround(_c(col), scale)


def python_round(col, ndigits: int = 0) -> Column:
    """Python's built-in ``round`` (nearest to the exact binary value, ties to
    even) for a double column - an Arrow helper for reproducing the original's
    printed tables; Spark's ``round``/``bround`` work on the shortest decimal."""
    @F.pandas_udf(T.DoubleType())
    def _round(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else round(float(v), ndigits))

    return _round(_c(col))


def stable(col, digits: int = 9) -> Column:
    """Round away float noise from summation order before comparing or rounding
    to few decimals (two engines summing in different orders then agree)."""
    return F.round(_c(col), digits)


def round_text(value, decimals: int) -> Column:
    """``%.{decimals}f`` of the value rounded half-up on its decimal form; a
    negative value that rounds to zero keeps its sign (``-0.0``) as in Python."""
    raw = stable(value)
    v = F.round(raw, decimals)
    txt = F.when(v.isNotNull(), F.format_string(f"%.{decimals}f", v))  # Java prints a NULL as text
    return F.when((v == 0) & (raw < 0), F.concat(F.lit("-"), txt)).otherwise(txt)


def signed_text(value, decimals: int = 1) -> Column:
    """Value rounded to ``decimals``, printed with a leading ``+`` when > 0.
    Rounding happens numerically first, so the text never depends on how a
    formatter breaks ties."""
    v = F.round(stable(value), decimals)
    txt = round_text(value, decimals)
    return F.when(v > 0, F.concat(F.lit("+"), txt)).otherwise(txt)


def mark_result(value, p_value, better, band=None, alpha: float = 0.05) -> Column:
    """``\\bf{..}`` when p < alpha and better; ``*`` when p > alpha and worse;
    wrapped in the effect band macro when a band is given."""
    txt = signed_text(value)
    p = _c(p_value)
    b = _c(better)
    out = (F.when((p < alpha) & b, F.concat(F.lit("\\bf{"), txt, F.lit("}")))
           .when((p > alpha) & ~b, F.concat(txt, F.lit("*"))).otherwise(txt))
    if band is not None:
        macro = (F.when(_c(band) == "large", F.lit("\\lef{")).when(_c(band) == "medium", F.lit("\\mef{"))
                 .when(_c(band) == "small", F.lit("\\sef{")))
        out = F.when(macro.isNotNull(), F.concat(macro, out, F.lit("}"))).otherwise(out)
    return out


def heat_text(value, p_value, is_baseline, alpha: float = 0.05) -> Column:
    """X14 heat-map cell: ``%.1f``, or ``%.2f`` when that rounds to 0; ``*`` when
    p < alpha; ``bsln`` at the baseline cell."""
    r1 = F.round(stable(value), 1)
    txt = F.when(r1 == 0, round_text(value, 2)).otherwise(round_text(value, 1))
    txt = F.when(_c(p_value) < alpha, F.concat(txt, F.lit("*"))).otherwise(txt)
    return F.when(_c(is_baseline), F.lit("bsln")).otherwise(txt)
