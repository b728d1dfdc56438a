"""Paired significance and effect size per cell.

Inputs are long tables: one row per (cell, seed) pair or per (cell, side,
value).  Ranks come from windows partitioned by cell; a cell holds one row per
seed after the run table is de-duplicated, so these partitions stay small.
The exact Wilcoxon null distribution is a subset-sum count table that depends
only on n (at most ~22,000 rows for n <= 50); it is built once and broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest n with an exact null distribution under method="auto" (SciPy's default for this test).
EXACT_MAX_N = 50

# erfc(x) without erf in either engine: 1 - erf from the Taylor series of erf
# (Horner form in x^2) below x = 2, the Laplace continued fraction above.
# Relative error below 2e-13 against math.erfc on [0, 10].
ERF_TERMS = 45
ERF_COEFFS = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(ERF_TERMS + 1)]
CF_TERMS = 60
SERIES_BELOW = 2.0
TWO_OVER_SQRT_PI = 2.0 / math.sqrt(math.pi)
SQRT_PI = math.sqrt(math.pi)

# A12 effect-size bands.
EFFECT_BANDS = [(0.71, "large"), (0.64, "medium"), (0.56, "small")]


def signed_rank_table(spark: SparkSession, max_n: int = EXACT_MAX_N) -> DataFrame:
    """Exact null CDF of the signed-rank statistic: ``(n, w, cdf)`` with
    cdf = P(W+ <= w) for n = 1..max_n.

    Subset-sum counts are built on the executors from ``range(1, max_n + 1)``
    (each n folds 1..n into a count array), so nothing but 50 numbers is
    planned on the driver; the size depends only on ``max_n`` (22,150 rows for
    50), which is what makes broadcasting it safe."""
    counts = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.lit(1).cast("long")), _with_rank)
    rows = (spark.range(1, max_n + 1).select(F.col("id").cast("int").alias("n"))
            .select("n", F.posexplode(counts).alias("w", "c")))
    w = Window.partitionBy("n").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("n", F.col("w").cast("int").alias("w"),
                       (F.sum("c").over(w) / F.pow(F.lit(2.0), F.col("n"))).alias("cdf"))


def _with_rank(counts: Column, k: Column) -> Column:
    """Subsets by their sum, from those without an item of size ``k``."""
    return F.transform(F.sequence(F.lit(0), F.size(counts) - 1 + k),
                       lambda w: F.coalesce(F.get(counts, w), F.lit(0).cast("long")) + F.coalesce(F.get(counts, w - k), F.lit(0).cast("long")))


def mid_rank_cdf(doubled: Column, t: Column) -> Column:
    """P(W+ <= t) where each of the mid-ranks (an array, doubled so that they are whole) has either sign with
    probability 1/2: a fold over the group's own ranks, at most 2^n subsets in n(n + 1) + 1 sums."""
    counts = F.aggregate(doubled, F.array(F.lit(1).cast("long")), _with_rank)
    below = F.aggregate(F.slice(counts, 1, F.round(2 * t).cast("int") + 1), F.lit(0).cast("long"), lambda acc, c: acc + c)
    return below / F.pow(F.lit(2.0), F.size(doubled))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 as a column expression."""
    y = x * x
    acc = F.lit(ERF_COEFFS[-1])
    for c in reversed(ERF_COEFFS[:-1]):
        acc = acc * y + F.lit(c)
    series = F.lit(1.0) - F.lit(TWO_OVER_SQRT_PI) * x * acc
    f = x
    for k in range(CF_TERMS, 0, -1):
        f = x + F.lit(k / 2.0) / f
    cf = F.exp(-y) / (F.lit(SQRT_PI) * f)
    return F.when(x < SERIES_BELOW, series).otherwise(cf)


def normal_sf2(z: Column) -> Column:
    """Two-sided normal tail 2*(1 - Phi(|z|)) = erfc(|z| / sqrt(2))."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def average_ranks(df: DataFrame, group_cols: list[str], value: Column, out: str = "rank") -> DataFrame:
    """1-based average ranks of ``value`` inside each group (ties share the mean rank)."""
    v = "__v"
    d = df.withColumn(v, value)
    w_min = Window.partitionBy(*group_cols).orderBy(v)
    w_tie = Window.partitionBy(*group_cols, v)
    return (d.withColumn("__rmin", F.rank().over(w_min))
            .withColumn("__t", F.count(F.lit(1)).over(w_tie))
            .withColumn(out, F.col("__rmin") + (F.col("__t") - 1) / 2.0)
            .drop("__rmin", v))


def wilcoxon_signed_rank(pairs: DataFrame, group_cols: list[str], d_col: str = "d", spark: SparkSession | None = None,
                         method: str = "auto", exact_max_n: int = EXACT_MAX_N, value_col: str | None = None) -> DataFrame:
    """Two-sided Wilcoxon signed-rank test per group on differences ``d``.

    Zero differences are dropped.  ``method="auto"``: exact p = min(1, 2 P(W+ <= T)) when
    there are no zeros and no ties and n <= ``exact_max_n``, otherwise the normal approximation
    with tie correction and no continuity correction.  ``"approx"`` approximates every group;
    ``"exact"`` takes the null distribution of a group's own mid-ranks, so ties and zeros (dropped) are exact
    as well: of all 2^n signs, those whose sum is no larger than T; it raises beyond ``exact_max_n`` pairs.
    All-zero -> NULL p.

    With ``value_col`` the groups also carry the mean and count of that column.

    One shuffle by group: every window shares the group partitioning and the
    final ``groupBy`` reuses it.  Zeros sort first by |d|, so the rank among
    non-zero differences is ``rank - zeros``; each row of a tie group of size
    t adds t*t - 1, which sums to the t(t^2 - 1) of the tie correction.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    spark = spark or pairs.sparkSession
    g = list(group_cols)
    d = F.col("__d")
    own = [value_col] if value_col else []
    x = pairs.select(*g, *own, F.col(d_col).alias("__d")).withColumn("__a", F.abs(d))
    # a row without difference ranks last and counts nowhere, but keeps its group in the result
    x = (x.withColumn("__z", F.sum(F.when(d == 0, 1).otherwise(0)).over(Window.partitionBy(*g)))
         .withColumn("__rk", F.rank().over(Window.partitionBy(*g).orderBy(F.asc_nulls_last("__a"))))
         .withColumn("__t", F.count(F.lit(1)).over(Window.partitionBy(*g, "__a")))
         .withColumn("__r", F.col("__rk") - F.col("__z") + (F.col("__t") - 1) / 2.0))
    nz = d != 0
    s = x.groupBy(*g).agg(
        F.sum(F.when(d == 0, 1).otherwise(0)).cast("long").alias("n_zero"),
        F.sum(F.when(nz, 1).otherwise(0)).cast("int").alias("n"),
        F.sum(F.when(d > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(d < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.when(nz, F.col("__t") * F.col("__t") - 1).otherwise(0)).alias("tie_term"),
        F.max(F.when(nz, F.col("__t"))).alias("max_tie"),
        *[a for c in own for a in (F.avg(c).alias("value_mean"), F.count(c).alias("value_n"))],
        *([F.collect_list(F.when(nz, (2 * F.col("__r")).cast("int"))).alias("__ranks")] if method == "exact" else []))
    s = s.withColumn("t_stat", F.least("w_plus", "w_minus"))
    exact = (F.col("n_zero") == 0) & (F.coalesce(F.col("max_tie"), F.lit(1)) <= 1) & \
            (F.col("n") <= exact_max_n) & (F.col("n") > 0)
    if method == "approx":
        exact = F.lit(False)
    elif method == "exact":
        exact = F.when(F.col("n") <= exact_max_n, F.col("n") > 0).otherwise(
            F.raise_error(F.lit("no exact null distribution: too many pairs")).cast("boolean"))
    s = s.withColumn("method", F.when(F.col("n") == 0, F.lit(None).cast("string"))
                     .when(exact, F.lit("exact")).otherwise(F.lit("approx")))
    n = F.col("n").cast("double")
    mn = n * (n + 1) / 4.0
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("tie_term")) / 24.0)
    s = s.withColumn("z", F.when(F.col("method") == "approx", F.try_divide(F.col("t_stat") - mn, se)))
    if method == "exact":
        s = s.withColumn("cdf", F.when(F.col("n") <= exact_max_n, mid_rank_cdf(F.col("__ranks"), F.col("t_stat"))))
    else:
        table = F.broadcast(signed_rank_table(spark, exact_max_n).withColumnRenamed("n", "__n"))
        s = s.withColumn("__w", F.floor("t_stat").cast("int"))
        s = s.join(table, (F.col("__n") == F.col("n")) & (F.col("w") == F.col("__w")) &
                   (F.col("method") == "exact"), "left")
    p = (F.when(F.col("method") == "exact", F.least(F.lit(1.0), 2 * F.col("cdf")))
         .when(F.col("method") == "approx", normal_sf2(F.col("z"))))
    return s.select(*g, "n", "n_zero", "w_plus", "w_minus", "t_stat", "method", "z", p.alias("p_value"),
                    *(["value_mean", "value_n"] if value_col else []))


def with_band(df: DataFrame) -> DataFrame:
    """Adds ``band``, the effect-size band of column ``a12``."""
    band = F.lit("none")
    for cut, name in reversed(EFFECT_BANDS):
        band = F.when(F.col("a12") >= cut, F.lit(name)).otherwise(band)
    return df.withColumn("band", F.when(F.col("a12").isNull(), None).otherwise(band))


def a12_effect_size(samples: DataFrame, group_cols: list[str], side_col: str = "side",
                    value_col: str = "value", first=1) -> DataFrame:
    """Vargha-Delaney A12 per group, undirected: max(s, 1 - s) with
    s = P(x > y) + 0.5 P(x = y), x from side ``first``.  Rank form over the
    union of both samples (no pairs are built)."""
    g = list(group_cols)
    r = average_ranks(samples, g, F.col(value_col), "r")
    agg = r.groupBy(*g).agg(
        F.sum(F.when(F.col(side_col) == first, F.col("r")).otherwise(0.0)).alias("r1"),
        F.sum(F.when(F.col(side_col) == first, 1).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col(side_col) != first, 1).otherwise(0)).alias("n2"))
    s = F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n2"))
    out = with_band(agg.withColumn("s", s).withColumn("a12", F.greatest(F.col("s"), 1 - F.col("s"))))
    return out.select(*g, F.col("n1").cast("int").alias("n1"), F.col("n2").cast("int").alias("n2"), "a12", "band")


def pair_counts(samples: DataFrame, group_cols: list[str], side_col: str = "side",
                value_col: str = "value", first=1) -> DataFrame:
    """The all-pairs comparison of two samples as counts - pairs with
    x > y and x = y - from per-value counts and a running sum; no pair rows."""
    g = list(group_cols)
    per = samples.groupBy(*g, value_col).agg(
        F.sum(F.when(F.col(side_col) == first, 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col(side_col) != first, 1).otherwise(0)).alias("b"))
    w = Window.partitionBy(*g).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("b_below", F.coalesce(F.sum("b").over(w), F.lit(0)))
    return per.groupBy(*g).agg(
        F.sum(F.col("a") * F.col("b_below")).cast("long").alias("more"),
        F.sum(F.col("a") * F.col("b")).cast("long").alias("same"),
        (F.sum("a") * F.sum("b")).cast("long").alias("pairs"))
