"""Registered queries of the run-analysis block (S9 data model on the derived
run table): W1, O1, J4, J5, J8, P5-P12, A9-A19, A26, T3, T4, X12-X15, K9."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timefmt as TF
from ..operators import runs as R
from ..operators import stats as ST
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks as SK
from .fixtures import runs, with_views
from .sqlparts import sround

QUERIES = {}
CELL_SQL = "dataset, combination_type, hidden_layer_to_use, not_special_tokens_to_zero"
METRIC = "acc_test"


def round_doubles(df: DataFrame, nd: int = 9) -> DataFrame:
    """Round every double column (floating sums differ in the last bits by order)."""
    return df.select(*[F.round(f.name, nd).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def r6(body: str, doubles: list[str]) -> str:
    if not doubles:
        return body
    rep = ", ".join(f"round({c}, 9) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({body})"


def _clean(spark, sf):
    return R.clean_runs(runs(spark, sf))


SQL_CLEAN = ("clean AS (SELECT * EXCLUDE (__rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, combination_type, "
             "hidden_layer_to_use, seed, epochs, not_special_tokens_to_zero ORDER BY ord DESC) AS __rn FROM runs "
             "WHERE acc_test IS NOT NULL AND NOT isnan(acc_test)) WHERE __rn = 1)")


def _dur_sql(ts):
    return f"strptime(split_part(split_part({ts}, '+', 1), '.', 1), '%Y-%m-%d %H:%M:%S')"


def cellv(metric=METRIC, name="cellv"):
    return f"{name} AS (SELECT {CELL_SQL}, seed, ord, {metric} AS value FROM clean WHERE epochs = 10)"


def base(metric=METRIC, name="base"):
    return (f"{name} AS (SELECT dataset, seed, {metric} AS base FROM clean WHERE combination_type = 'one_layer_cls' "
            f"AND hidden_layer_to_use = 12 AND epochs = 10 AND NOT not_special_tokens_to_zero)")


def bstats(name="bstats", src="base"):
    return (f"{name} AS (SELECT dataset, avg(base) AS base_mean, max(base) AS base_max, count(base) AS base_n "
            f"FROM {src} GROUP BY dataset)")


def _erfc_sql(z: str) -> str:
    """SQL twin of ``stats.normal_sf2``: the same series / continued fraction."""
    x = f"(abs({z}) / sqrt(2.0))"
    y = f"({x} * {x})"
    acc = repr(ST.ERF_COEFFS[-1])
    for c in reversed(ST.ERF_COEFFS[:-1]):
        acc = f"(({acc}) * {y} + {c!r})"
    series = f"(1.0 - {ST.TWO_OVER_SQRT_PI!r} * {x} * {acc})"
    f = x
    for k in range(ST.CF_TERMS, 0, -1):
        f = f"({x} + {k / 2.0!r} / {f})"
    cf = f"(exp(-{y}) / ({ST.SQRT_PI!r} * {f}))"
    return f"(CASE WHEN {x} < {ST.SERIES_BELOW!r} THEN {series} ELSE {cf} END)"


SQL_CDF = [
    "dp(n, c) AS (SELECT 0, [1::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), "
    "lambda w: coalesce(c[w + 1], 0) + CASE WHEN w >= n + 1 THEN coalesce(c[w - n], 0) ELSE 0 END) FROM dp WHERE n < 50)",
    "cdf AS (SELECT CAST(n AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS w, sum(x) OVER (PARTITION BY n ORDER BY i) / pow(2, n) AS cdf "
    "FROM (SELECT n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM dp WHERE n >= 1))",
]


def wilcoxon_ctes(prefix: str, pairs: str, g: str) -> list[str]:
    """CTE ``prefix``: (g..., n, n_zero, w_plus, w_minus, t_stat, method, z, p_value)."""
    gl = [c.strip() for c in g.split(",")]
    using = ", ".join(gl)
    return [
        f"{prefix}_z AS (SELECT {g}, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM {pairs} GROUP BY {g})",
        f"{prefix}_nz AS (SELECT {g}, d, abs(d) AS a FROM {pairs} WHERE d <> 0)",
        f"{prefix}_rk AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY a) + (count(*) OVER (PARTITION BY {g}, a) - 1) / 2.0 AS r FROM {prefix}_nz)",
        f"{prefix}_tie AS (SELECT {g}, sum(t * (t * t - 1)) AS tie_term, max(t) AS max_tie FROM "
        f"(SELECT {g}, a, count(*) AS t FROM {prefix}_nz GROUP BY {g}, a) GROUP BY {g})",
        f"{prefix}_ag AS (SELECT {g}, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus, "
        f"sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus FROM {prefix}_rk GROUP BY {g})",
        f"""{prefix}_st AS (SELECT {g}, CAST(coalesce(n, 0) AS INTEGER) AS n, n_zero, coalesce(w_plus, 0.0) AS w_plus,
  coalesce(w_minus, 0.0) AS w_minus, least(coalesce(w_plus, 0.0), coalesce(w_minus, 0.0)) AS t_stat, tie_term, max_tie
  FROM {prefix}_z LEFT JOIN {prefix}_ag USING ({using}) LEFT JOIN {prefix}_tie USING ({using}))""",
        f"""{prefix}_me AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n_zero = 0 AND coalesce(max_tie, 1) <= 1 AND n <= 50
  THEN 'exact' ELSE 'approx' END AS method FROM {prefix}_st)""",
        f"""{prefix}_zz AS (SELECT *, CASE WHEN method = 'approx' THEN (t_stat - CAST(n AS DOUBLE) * (n + 1) / 4.0) /
  nullif(sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - 0.5 * coalesce(tie_term, 0)) / 24.0), 0) END AS z FROM {prefix}_me)""",
        f"""{prefix} AS (SELECT {', '.join('s.' + c for c in gl)}, s.n, s.n_zero, s.w_plus, s.w_minus, s.t_stat, s.method, s.z,
  CASE WHEN s.method = 'exact' THEN least(1.0, 2 * c.cdf) WHEN s.method = 'approx' THEN {_erfc_sql('s.z')} END AS p_value
  FROM {prefix}_zz s LEFT JOIN cdf c ON s.method = 'exact' AND c.n = s.n AND c.w = CAST(floor(s.t_stat) AS INTEGER))""",
    ]


def avg_rank_sql(src: str, g: str, v: str) -> str:
    return (f"SELECT *, rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0 AS r "
            f"FROM {src}")


# -- cleaning, grid, coverage ----------------------------------------------

def _w1(spark, sf):
    return R.keep_last_run(runs(spark, sf))


QUERIES["W1_keep_last_run"] = (_w1, with_views(
    "SELECT * EXCLUDE (__rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, combination_type, hidden_layer_to_use, "
    "seed, epochs, not_special_tokens_to_zero ORDER BY ord DESC) AS __rn FROM runs) WHERE __rn = 1", "runs"))


def _p6(spark, sf):
    return R.drop_missing_metric(runs(spark, sf)).select("ord", "dataset", "acc_test")


QUERIES["P6_drop_missing_metric"] = (_p6, with_views(
    "SELECT ord, dataset, acc_test FROM runs WHERE acc_test IS NOT NULL AND NOT isnan(acc_test)", "runs"))


def _p5(spark, sf):
    return R.run_cell(_clean(spark, sf), "one_layer_cls", 12, False, METRIC)


QUERIES["P5_run_cell"] = (_p5, with_views(
    "SELECT dataset, seed, ord, acc_test AS value FROM clean WHERE combination_type = 'one_layer_cls' AND "
    "hidden_layer_to_use = 12 AND epochs = 10 AND not_special_tokens_to_zero = false", "runs", ctes=[SQL_CLEAN]))


def _o1(spark, sf):
    return R.run_grid(runs(spark, sf))


_GRID_SQL = """grid AS (SELECT d.dataset, CAST(s.seed AS INTEGER) AS seed, c.comb AS combination_type,
  CAST(l.layer AS INTEGER) AS hidden_layer_to_use, f.flag AS not_special_tokens_to_zero
  FROM (SELECT DISTINCT dataset FROM runs) d,
       (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 42]) AS seed) s,
       (SELECT unnest(['""" + "', '".join(R.COMBINATIONS) + """']) AS comb) c,
       (SELECT unnest(range(1, 13)) AS layer) l,
       (SELECT unnest([true, false]) AS flag) f
  WHERE (CASE WHEN contains(c.comb, 'one_layer') AND contains(c.comb, 'cutoff') THEN l.layer <= 11
              WHEN contains(c.comb, 'one_layer') THEN true ELSE l.layer = 12 END)
    AND (NOT contains(c.comb, 'cls') OR NOT f.flag))"""

QUERIES["O1_run_grid"] = (_o1, with_views("SELECT * FROM grid", "runs", ctes=[_GRID_SQL]))


def _j4(spark, sf):
    return R.missing_runs(runs(spark, sf))


QUERIES["J4_missing_runs"] = (_j4, with_views(
    "SELECT g.* FROM grid g ANTI JOIN (SELECT DISTINCT dataset, seed, combination_type, hidden_layer_to_use, "
    "not_special_tokens_to_zero FROM runs WHERE epochs = 10 AND acc_test IS NOT NULL AND NOT isnan(acc_test)) p "
    "USING (dataset, seed, combination_type, hidden_layer_to_use, not_special_tokens_to_zero)", "runs", ctes=[_GRID_SQL]))


def _a19(spark, sf):
    return R.seed_coverage(_clean(spark, sf))


QUERIES["A19_seed_coverage"] = (_a19, with_views(
    f"SELECT {CELL_SQL}, count(*) AS n_values, array_to_string(list_sort(list_filter(list(DISTINCT seed), "
    "lambda s: NOT list_contains([1, 2, 3, 4, 5, 6, 7, 8, 9, 42], s))), ',') AS unknown_seeds "
    f"FROM clean WHERE epochs = 10 GROUP BY {CELL_SQL} HAVING count(*) <> 10 OR len(list_filter(list(DISTINCT seed), "
    "lambda s: NOT list_contains([1, 2, 3, 4, 5, 6, 7, 8, 9, 42], s))) > 0", "runs", ctes=[SQL_CLEAN]))


# -- names and predicates ---------------------------------------------------

def _p10(spark, sf):
    r = runs(spark, sf)
    return r.select(R.COMB, R.FLAG, R.variant_key().alias("variant")).distinct()


QUERIES["P10_variant_key"] = (_p10, with_views(
    "SELECT DISTINCT combination_type, not_special_tokens_to_zero, CASE WHEN NOT not_special_tokens_to_zero AND "
    "NOT contains(combination_type, 'cls') THEN combination_type || '_zero_out_sp_tokens' ELSE combination_type END AS variant "
    "FROM runs", "runs"))


def _p12(spark, sf):
    r = runs(spark, sf).select(R.COMB).distinct()
    fam = R.family()
    return r.select(R.COMB, *[v.alias(f"is_{k}") for k, v in fam.items()])


QUERIES["P12_combination_family"] = (_p12, with_views(
    "SELECT DISTINCT combination_type, contains(combination_type, 'one_layer') AS is_one_layer, "
    "contains(combination_type, 'cutoff') AS is_cutoff, contains(combination_type, 'cls') AS is_cls, "
    "contains(combination_type, 'w_') AS is_w_sum FROM runs", "runs"))


def _p11(spark, sf):
    return round_doubles(runs(spark, sf).select("ord", R.scale_100("acc_test").alias("acc_pct")))


QUERIES["P11_scale_100"] = (_p11, with_views(r6("SELECT ord, acc_test * 100.0 AS acc_pct FROM runs", ["acc_pct"]), "runs"))


def _p9(spark, sf):
    r = runs(spark, sf).select(R.variant_key().alias("variant"), R.LAYER).distinct()
    plot = R.display_names(r).withColumnRenamed("display_name", "plot_name")
    return R.display_names(plot, names=R.HEATMAP_NAMES).withColumnRenamed("display_name", "heatmap_name")


def _names_values_sql(name, names):
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in names.items())
    return f"{name}(variant, template) AS (VALUES {rows})"


QUERIES["P9_display_names"] = (_p9, with_views(
    "SELECT v.variant, v.hidden_layer_to_use, replace(n.template, '{l}', CAST(v.hidden_layer_to_use AS VARCHAR)) AS plot_name, "
    "h.template AS heatmap_name "
    "FROM (SELECT DISTINCT CASE WHEN NOT not_special_tokens_to_zero AND NOT contains(combination_type, 'cls') "
    "THEN combination_type || '_zero_out_sp_tokens' ELSE combination_type END AS variant, hidden_layer_to_use FROM runs) v "
    "LEFT JOIN names n ON v.variant = n.variant LEFT JOIN heats h ON v.variant = h.variant", "runs",
    ctes=[_names_values_sql("names", R.PLOT_NAMES), _names_values_sql("heats", R.HEATMAP_NAMES)]))


# -- cell statistics --------------------------------------------------------

def _a9(spark, sf):
    return round_doubles(R.cell_stats(_clean(spark, sf), METRIC))


QUERIES["A9_cell_stats"] = (_a9, with_views(r6(
    f"SELECT {CELL_SQL}, avg(value) AS mean, max(value) AS max, count(value) AS n FROM cellv GROUP BY {CELL_SQL}",
    ["mean", "max"]), "runs", ctes=[SQL_CLEAN, cellv()]))


def _j5(spark, sf):
    return round_doubles(R.baseline_stats(_clean(spark, sf), METRIC))


QUERIES["J5_baseline_join"] = (_j5, with_views(r6("SELECT * FROM bstats", ["base_mean", "base_max"]), "runs",
                                               ctes=[SQL_CLEAN, base(), bstats()]))

SQL_PAIRS = "pairs AS (SELECT v.*, b.base, v.value - b.base AS d FROM cellv v JOIN base b USING (dataset, seed))"


def _a16(spark, sf):
    return round_doubles(R.cell_tests(_clean(spark, sf), METRIC))


QUERIES["A16_wilcoxon_signed_rank"] = (_a16, with_views(
    r6("SELECT c.*, CAST(coalesce(w.n, 0) AS INTEGER) AS n, CAST(coalesce(w.n_zero, 0) AS BIGINT) AS n_zero, w.w_plus, "
       "w.w_minus, w.t_stat, w.method, w.z, w.p_value FROM (SELECT DISTINCT " + CELL_SQL + " FROM cellv) c "
       "LEFT JOIN wx w USING (" + CELL_SQL + ")", ["w_plus", "w_minus", "t_stat", "z", "p_value"]), "runs",
    ctes=[SQL_CLEAN, cellv(), base(), SQL_PAIRS, *SQL_CDF, *wilcoxon_ctes("wx", "pairs", CELL_SQL)], recursive=True))

SQL_SAMPLES = ("samples AS (SELECT " + CELL_SQL + ", 1 AS side, value FROM cellv UNION ALL "
               "SELECT c.dataset, c.combination_type, c.hidden_layer_to_use, c.not_special_tokens_to_zero, 2, b.base "
               "FROM (SELECT DISTINCT " + CELL_SQL + " FROM cellv) c JOIN base b ON c.dataset = b.dataset)")


def _a17(spark, sf):
    return round_doubles(R.cell_effects(_clean(spark, sf), METRIC))


SQL_A12 = ("a12t AS (SELECT " + CELL_SQL + ", CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, greatest(s, 1 - s) AS a12 FROM "
           "(SELECT " + CELL_SQL + ", sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN side <> 1 THEN 1 ELSE 0 END) AS n2, "
           "(sum(CASE WHEN side = 1 THEN r ELSE 0.0 END) - sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) * "
           "(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) + 1) / 2.0) / nullif(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) * "
           "sum(CASE WHEN side <> 1 THEN 1 ELSE 0 END), 0) AS s FROM (" + avg_rank_sql("samples", CELL_SQL, "value") +
           ") GROUP BY " + CELL_SQL + "))")

def _a17d(spark, sf):
    return round_doubles(R.cell_effects(_clean(spark, sf), R.run_seconds()))


SQL_BAND = ("CASE WHEN a12 IS NULL THEN NULL WHEN a12 >= 0.71 THEN 'large' WHEN a12 >= 0.64 THEN 'medium' "
            "WHEN a12 >= 0.56 THEN 'small' ELSE 'none' END")

QUERIES["A17_a12_effect_size"] = (_a17, with_views(
    r6(f"SELECT *, {SQL_BAND} AS band FROM a12t", ["a12"]), "runs",
    ctes=[SQL_CLEAN, cellv(), base(), SQL_SAMPLES, SQL_A12]))


def _seconds_sql():
    return f"CAST(epoch({_dur_sql('end_time')}) - epoch({_dur_sql('start_time')}) AS DOUBLE)"


QUERIES["A17_a12_effect_size_durations"] = (_a17d, with_views(
    r6(f"SELECT *, {SQL_BAND} AS band FROM a12t", ["a12"]), "runs",
    ctes=[SQL_CLEAN, cellv(_seconds_sql()), base(_seconds_sql()), SQL_SAMPLES, SQL_A12]))


def _j8(spark, sf):
    return R.cell_pair_counts(_clean(spark, sf), METRIC)


QUERIES["J8_all_pairs"] = (_j8, with_views(
    "SELECT c.*, CAST(coalesce(p.more, 0) AS BIGINT) AS more, CAST(coalesce(p.same, 0) AS BIGINT) AS same, "
    "CAST(coalesce(p.pairs, 0) AS BIGINT) AS pairs FROM (SELECT DISTINCT " + CELL_SQL + " FROM samples) c LEFT JOIN ("
    "SELECT x.dataset, x.combination_type, x.hidden_layer_to_use, x.not_special_tokens_to_zero, "
    "sum(CASE WHEN x.value > y.value THEN 1 ELSE 0 END) AS more, "
    "sum(CASE WHEN x.value = y.value THEN 1 ELSE 0 END) AS same, count(*) AS pairs "
    "FROM samples x JOIN samples y ON x.dataset = y.dataset AND x.combination_type = y.combination_type AND "
    "x.hidden_layer_to_use = y.hidden_layer_to_use AND x.not_special_tokens_to_zero = y.not_special_tokens_to_zero "
    "AND x.side = 1 AND y.side = 2 GROUP BY ALL) p USING (" + CELL_SQL + ")", "runs",
    ctes=[SQL_CLEAN, cellv(), base(), SQL_SAMPLES]))

SQL_COMPARE = [
    SQL_CLEAN, cellv(), base(), bstats(), SQL_PAIRS, *SQL_CDF, *wilcoxon_ctes("wx", "pairs", CELL_SQL),
    f"cst AS (SELECT {CELL_SQL}, avg(value) AS mean FROM cellv GROUP BY {CELL_SQL})",
    f"cmp AS (SELECT c.*, b.base_mean, w.p_value, round(c.mean, 9) > round(b.base_mean, 9) AS better FROM cst c JOIN bstats b USING (dataset) "
    f"LEFT JOIN wx w USING ({CELL_SQL}))",
]


def _p7(spark, sf):
    return round_doubles(R.better_than_baseline(cut_lineage(_clean(spark, sf)), METRIC))


QUERIES["P7_better_than_baseline"] = (_p7, with_views(
    r6(f"SELECT {CELL_SQL}, mean, base_mean, p_value FROM cmp WHERE better", ["mean", "base_mean", "p_value"]),
    "runs", ctes=SQL_COMPARE, recursive=True))


def _p8(spark, sf):
    return round_doubles(R.all_cells_with_p(cut_lineage(_clean(spark, sf)), METRIC))


QUERIES["P8_all_cells_with_p"] = (_p8, with_views(
    r6(f"SELECT {CELL_SQL}, mean, base_mean, CASE WHEN better THEN p_value END AS p_value FROM cmp",
       ["mean", "base_mean", "p_value"]), "runs", ctes=SQL_COMPARE, recursive=True))

SQL_DELTA = [
    SQL_CLEAN, cellv(), base(), bstats(),
    f"""dlong AS (SELECT dataset, stat, variant, hidden_layer_to_use, delta FROM (
  SELECT c.dataset, CASE WHEN NOT c.not_special_tokens_to_zero AND NOT contains(c.combination_type, 'cls')
         THEN c.combination_type || '_zero_out_sp_tokens' ELSE c.combination_type END AS variant, c.hidden_layer_to_use,
         (c.mx - b.base_max) * 100 AS dmax, (c.mean - b.base_mean) * 100 AS dmean
  FROM (SELECT {CELL_SQL}, max(value) AS mx, avg(value) AS mean FROM cellv
        WHERE contains(combination_type, 'one_layer') AND NOT contains(combination_type, 'cutoff') GROUP BY {CELL_SQL}) c
  JOIN bstats b USING (dataset))
  UNPIVOT (delta FOR stat IN (dmax AS 'max', dmean AS 'mean')))""",
]


def _a10(spark, sf):
    return round_doubles(R.delta_matrix(_clean(spark, sf), METRIC))


QUERIES["A10_delta_matrix"] = (_a10, with_views(
    r6("SELECT dataset, stat, variant, " + ", ".join(
        f"max(CASE WHEN hidden_layer_to_use = {i} THEN delta END) AS l{i}" for i in range(1, 13)) +
       " FROM dlong GROUP BY dataset, stat, variant", [f"l{i}" for i in range(1, 13)]),
    "runs", ctes=SQL_DELTA))


def _a10p(spark, sf):
    return round_doubles(R.pvalue_matrix(_clean(spark, sf), METRIC))


QUERIES["A10_pvalue_matrix"] = (_a10p, with_views(
    r6("SELECT dataset, CASE WHEN NOT not_special_tokens_to_zero AND NOT contains(combination_type, 'cls') "
       "THEN combination_type || '_zero_out_sp_tokens' ELSE combination_type END AS variant, " + ", ".join(
           f"max(CASE WHEN hidden_layer_to_use = {i} THEN p_value END) AS l{i}" for i in range(1, 13)) +
       " FROM (SELECT DISTINCT " + CELL_SQL + " FROM cellv) c LEFT JOIN wx USING (" + CELL_SQL + ") "
       "WHERE contains(combination_type, 'one_layer') AND NOT contains(combination_type, 'cutoff') "
       "GROUP BY ALL", [f"l{i}" for i in range(1, 13)]),
    "runs", ctes=[SQL_CLEAN, cellv(), base(), SQL_PAIRS, *SQL_CDF, *wilcoxon_ctes("wx", "pairs", CELL_SQL)],
    recursive=True))


SQL_DELTA_ALL = f"""dall AS (SELECT dataset, stat, variant, delta FROM (
  SELECT c.dataset, CASE WHEN NOT c.not_special_tokens_to_zero AND NOT contains(c.combination_type, 'cls')
         THEN c.combination_type || '_zero_out_sp_tokens' ELSE c.combination_type END AS variant,
         (c.mx - b.base_max) * 100 AS dmax, (c.mean - b.base_mean) * 100 AS dmean
  FROM (SELECT {CELL_SQL}, max(value) AS mx, avg(value) AS mean FROM cellv
        WHERE NOT contains(combination_type, 'one_layer') AND hidden_layer_to_use = 12 GROUP BY {CELL_SQL}) c
  JOIN bstats b USING (dataset))
  UNPIVOT (delta FOR stat IN (dmax AS 'max', dmean AS 'mean')))"""


def _a10_all(metric):
    def run(spark, sf):
        return round_doubles(R.delta_matrix(_clean(spark, sf), metric, half="all_layers"))
    return run


def _a10_all_p(metric):
    def run(spark, sf):
        return round_doubles(R.pvalue_matrix(_clean(spark, sf), metric, half="all_layers"))
    return run


for _m in (METRIC, "f1_weighted_test"):
    _s = _m.replace("_test", "")
    QUERIES[f"A10_delta_matrix_all_layers_{_s}"] = (_a10_all(_m), with_views(
        r6("SELECT dataset, stat, variant, delta AS l12 FROM dall", ["l12"]), "runs",
        ctes=[SQL_CLEAN, cellv(_m), base(_m), bstats(), SQL_DELTA_ALL]))
    QUERIES[f"A10_pvalue_matrix_all_layers_{_s}"] = (_a10_all_p(_m), with_views(
        r6("SELECT dataset, CASE WHEN NOT not_special_tokens_to_zero AND NOT contains(combination_type, 'cls') "
           "THEN combination_type || '_zero_out_sp_tokens' ELSE combination_type END AS variant, p_value AS l12 "
           "FROM (SELECT DISTINCT " + CELL_SQL + " FROM cellv) c LEFT JOIN wx USING (" + CELL_SQL + ") "
           "WHERE NOT contains(combination_type, 'one_layer') AND hidden_layer_to_use = 12", ["l12"]),
        "runs", ctes=[SQL_CLEAN, cellv(_m), base(_m), SQL_PAIRS, *SQL_CDF, *wilcoxon_ctes("wx", "pairs", CELL_SQL)],
        recursive=True))


def _t3(spark, sf):
    return round_doubles(R.best_cell(R.delta_matrix(_clean(spark, sf), METRIC, long=True)))


QUERIES["T3_best_cell"] = (_t3, with_views(
    r6("SELECT dataset, stat, variant, hidden_layer_to_use, delta FROM (SELECT *, rank() OVER (PARTITION BY dataset, stat "
       "ORDER BY delta DESC) AS rk FROM dlong WHERE delta IS NOT NULL) WHERE rk = 1", ["delta"]),
    "runs", ctes=SQL_DELTA))

def _t4(spark, sf):
    """The all-layer matrix in the order of its twelve rows."""
    d = R.delta_matrix(_clean(spark, sf), METRIC, half="all_layers").where(F.col("variant").isin(R.MATRIX_ORDER))
    return round_doubles(R.ordered_output(d, R.MATRIX_ORDER))


QUERIES["T4_ordered_output"] = (_t4, with_views(
    r6("SELECT m.dataset, m.stat, m.variant, m.delta AS l12, o.row_rank FROM dall m JOIN (VALUES " +
       ", ".join(f"('{v}', {i})" for i, v in enumerate(R.MATRIX_ORDER)) + ") o(variant, row_rank) USING (variant)", ["l12"]),
    "runs", ctes=[SQL_CLEAN, cellv(), base(), bstats(), SQL_DELTA_ALL]))


# -- pruned-model table pieces ----------------------------------------------

def _a11(spark, sf):
    return round_doubles(R.percent_of_baseline(_clean(spark, sf), "num_trainable_parameters"))


def _pct_sql(metric):
    return [SQL_CLEAN, cellv(metric), base(metric), bstats()]


QUERIES["A11_percent_of_baseline"] = (_a11, with_views(r6(
    "SELECT s.dataset, s.hidden_layer_to_use, s.n, CASE WHEN s.n = 10 THEN s.mean / b.base_mean * 100 END AS pct FROM "
    "(SELECT dataset, hidden_layer_to_use, avg(value) AS mean, count(value) AS n FROM cellv WHERE combination_type = "
    "'cutoff_layers_one_layer_cls' AND NOT not_special_tokens_to_zero GROUP BY ALL) s JOIN bstats b USING (dataset)", ["pct"]),
    "runs", ctes=_pct_sql("num_trainable_parameters")))


def _a11_time(spark, sf):
    return round_doubles(R.percent_of_baseline(_clean(spark, sf), "total_time"))


def _secs_sql(col):
    return (f"(CAST(split_part({col}, ':', 1) AS BIGINT) * 3600 + CAST(split_part({col}, ':', 2) AS BIGINT) * 60 "
            f"+ CAST(split_part({col}, ':', 3) AS BIGINT))")


QUERIES["A11_percent_of_baseline_total_time"] = (_a11_time, with_views(r6(
    "SELECT s.dataset, s.hidden_layer_to_use, s.n, CASE WHEN s.n = 10 THEN s.mean / b.base_mean * 100 END AS pct FROM "
    "(SELECT dataset, hidden_layer_to_use, avg(value) AS mean, count(value) AS n FROM cellv WHERE combination_type = "
    "'cutoff_layers_one_layer_cls' AND NOT not_special_tokens_to_zero GROUP BY ALL) s JOIN bstats b USING (dataset)", ["pct"]),
    "runs", ctes=[SQL_CLEAN, cellv(f"CAST({_secs_sql('total_time')} AS DOUBLE)"),
                  base(f"CAST({_secs_sql('total_time')} AS DOUBLE)"), bstats()]))


def _a12(spark, sf):
    return round_doubles(R.param_overhead(_clean(spark, sf), ("one_layer_w_sum_tokens", "w_sum_cls")))


QUERIES["A12_param_overhead"] = (_a12, with_views(r6(
    "SELECT s.dataset, s.combination_type, s.mean_params, b.base_mean AS baseline_params, "
    "(s.mean_params - b.base_mean) / b.base_mean * 100 AS diff_pct FROM (SELECT dataset, combination_type, "
    "avg(value) AS mean_params FROM cellv WHERE combination_type IN ('one_layer_w_sum_tokens', 'w_sum_cls') AND "
    "hidden_layer_to_use = 12 AND NOT not_special_tokens_to_zero GROUP BY ALL) s JOIN bstats b USING (dataset)",
    ["mean_params", "baseline_params", "diff_pct"]), "runs", ctes=_pct_sql("num_trainable_parameters")))


SQL_DUR = ("dur AS (SELECT dataset, hidden_layer_to_use, avg(epoch(" + _dur_sql("end_time") + ") - epoch(" +
           _dur_sql("start_time") + ")) AS total_seconds, avg(time_train_min * 60.0) AS epoch_seconds FROM clean "
           "WHERE epochs = 10 AND NOT not_special_tokens_to_zero AND ((combination_type = 'cutoff_layers_one_layer_cls' "
           "AND hidden_layer_to_use < 12) OR (combination_type = 'one_layer_cls' AND hidden_layer_to_use = 12)) GROUP BY ALL)")
SQL_SPEED = ("speed AS (SELECT d.dataset, d.hidden_layer_to_use, " + sround("b.epoch_seconds / d.epoch_seconds", 1) + " AS speedup "
             "FROM dur d JOIN (SELECT dataset, epoch_seconds FROM dur WHERE hidden_layer_to_use = 12) b USING (dataset))")


def _a14(spark, sf):
    return round_doubles(R.duration_table(_clean(spark, sf)))


QUERIES["A14_duration_table"] = (_a14, with_views(r6("SELECT * FROM dur", ["total_seconds", "epoch_seconds"]),
                                                  "runs", ctes=[SQL_CLEAN, SQL_DUR]))


def _a13(spark, sf):
    return R.speedup(_clean(spark, sf))


QUERIES["A13_speedup"] = (_a13, with_views("SELECT * FROM speed", "runs", ctes=[SQL_CLEAN, SQL_DUR, SQL_SPEED]))

_A15_METRICS = ["acc_test", "balanced_acc_test", "f1_micro_test", "f1_weighted_test"]


def _a15(spark, sf):
    return round_doubles(R.pruned_table(_clean(spark, sf), _A15_METRICS))


def _a15_parts(metrics):
    ctes = [SQL_CLEAN, *SQL_CDF, SQL_DUR, SQL_SPEED, cellv("num_trainable_parameters", "cv_par"),
            base("num_trainable_parameters", "b_par"), bstats("bs_par", "b_par")]
    ctes.append("par AS (SELECT s.dataset, s.hidden_layer_to_use, " + sround("CASE WHEN s.n = 10 THEN s.mean / b.base_mean * 100 END", 0) + " "
                "AS params_pct FROM (SELECT dataset, hidden_layer_to_use, avg(value) AS mean, count(value) AS n FROM cv_par "
                "WHERE combination_type = 'cutoff_layers_one_layer_cls' AND NOT not_special_tokens_to_zero AND hidden_layer_to_use < 12 "
                "GROUP BY ALL) s JOIN bs_par b USING (dataset) UNION ALL SELECT dataset, 12, base_mean FROM bs_par)")
    sel = ["coalesce(p.dataset, u.dataset) AS dataset", "coalesce(p.hidden_layer_to_use, u.hidden_layer_to_use) AS hidden_layer_to_use",
           "p.params_pct", "u.total_seconds", "u.epoch_seconds"]
    joins = ""
    for m in metrics:
        s = m.replace("_test", "")
        ctes += [cellv(m, f"cv_{s}"), base(m, f"b_{s}"), bstats(f"bs_{s}", f"b_{s}"),
                 f"pr_{s} AS (SELECT v.dataset, v.hidden_layer_to_use, v.value - b.base AS d FROM cv_{s} v JOIN b_{s} b "
                 f"USING (dataset, seed) WHERE v.combination_type = 'cutoff_layers_one_layer_cls' AND NOT v.not_special_tokens_to_zero "
                 f"AND v.hidden_layer_to_use < 12)",
                 *wilcoxon_ctes(f"wx_{s}", f"pr_{s}", "dataset, hidden_layer_to_use"),
                 f"df_{s} AS (SELECT s.dataset, s.hidden_layer_to_use, {sround(sround('s.mean * 100', 1) + ' - ' + sround('b.base_mean * 100', 2), 1)} "
                 f"AS diff_{s} FROM (SELECT dataset, hidden_layer_to_use, avg(value) AS mean FROM cv_{s} WHERE combination_type = "
                 f"'cutoff_layers_one_layer_cls' AND NOT not_special_tokens_to_zero AND hidden_layer_to_use < 12 GROUP BY ALL) s "
                 f"JOIN bs_{s} b USING (dataset) "
                 f"UNION ALL SELECT dataset, 12, {sround('base_mean * 100', 2)} FROM bs_{s})"]
        sel += [f"df_{s}.diff_{s}", f"wx_{s}.p_value AS p_{s}"]
        joins += (f" LEFT JOIN df_{s} ON df_{s}.dataset = k.dataset AND df_{s}.hidden_layer_to_use = k.hidden_layer_to_use"
                  f" LEFT JOIN wx_{s} ON wx_{s}.dataset = k.dataset AND wx_{s}.hidden_layer_to_use = k.hidden_layer_to_use")
    body = ("SELECT k.dataset, k.hidden_layer_to_use, k.params_pct, k.total_seconds, k.epoch_seconds, s.speedup, "
            + ", ".join(sel[5:]) + " FROM (SELECT " + ", ".join(sel[:5]) +
            " FROM par p FULL OUTER JOIN dur u ON p.dataset = u.dataset AND p.hidden_layer_to_use = u.hidden_layer_to_use) k "
            "LEFT JOIN speed s ON s.dataset = k.dataset AND s.hidden_layer_to_use = k.hidden_layer_to_use" + joins)
    return ctes, body


def _a15_sql():
    ctes, body = _a15_parts(_A15_METRICS)
    doubles = ["params_pct", "total_seconds", "epoch_seconds", "speedup"] + \
        [f"{p}_{m.replace('_test', '')}" for m in _A15_METRICS for p in ("diff", "p")]
    return with_views(r6(body, doubles), "runs", ctes=ctes, recursive=True)


QUERIES["A15_pruned_table"] = (_a15, _a15_sql())


def _k9(spark, sf):
    """The reduced-model table of all datasets, written and read back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"k9-{uuid.uuid4().hex[:12]}")
    SK.write_result_tables(round_doubles(R.reduced_models(cut_lineage(_clean(spark, sf)))), path)
    return spark.read.parquet(path)


def _mark_sql(delta, p, band):
    r = sround(delta, 1)
    txt = (f"(CASE WHEN {r} > 0 THEN '+' ELSE '' END || CASE WHEN {r} = 0 AND round({delta}, 9) < 0 THEN '-' ELSE '' END "
           f"|| printf('%.1f', {r}))")
    mark = (f"(CASE WHEN {p} < 0.05 AND {delta} > 0 THEN '\\bf{{' || {txt} || '}}' WHEN {p} > 0.05 AND NOT {delta} > 0 "
            f"THEN {txt} || '*' ELSE {txt} END)")
    return (f"(CASE {band} WHEN 'large' THEN '\\lef{{' || {mark} || '}}' WHEN 'medium' THEN '\\mef{{' || {mark} || '}}' "
            f"WHEN 'small' THEN '\\sef{{' || {mark} || '}}' ELSE {mark} END)")


def _k9_sql():
    ctes, body = _a15_parts(["acc_test", "f1_weighted_test"])
    ctes += [f"pt AS ({body})", cellv(_seconds_sql(), "cv_time"), base(_seconds_sql(), "b_time")]
    joins = ""
    for s in ("time", "acc", "f1_weighted"):
        ctes += [SQL_SAMPLES.replace("samples AS", f"samples_{s} AS").replace("cellv", f"cv_{s}").replace("JOIN base b", f"JOIN b_{s} b"),
                 SQL_A12.replace("a12t AS", f"a12_{s} AS").replace(avg_rank_sql("samples", CELL_SQL, "value"), avg_rank_sql(f"samples_{s}", CELL_SQL, "value")),
                 f"e_{s} AS (SELECT dataset, hidden_layer_to_use, {SQL_BAND} AS band FROM a12_{s} WHERE combination_type = "
                 "'cutoff_layers_one_layer_cls' AND NOT not_special_tokens_to_zero)"]
        joins += f" LEFT JOIN e_{s} ON e_{s}.dataset = pt.dataset AND e_{s}.hidden_layer_to_use = pt.hidden_layer_to_use"
    cells = ", ".join(f"CASE WHEN pt.hidden_layer_to_use < 12 THEN {_mark_sql(f'pt.diff_{s}', f'pt.p_{s}', f'e_{s}.band')} "
                      f"ELSE printf('%.1f', {sround(f'pt.diff_{s}', 1)}) END AS {s}" for s in ("acc", "f1_weighted"))
    return with_views(r6("SELECT pt.dataset, pt.hidden_layer_to_use, pt.epoch_seconds, pt.speedup, " + cells + ", e_time.band AS band_time "
                         "FROM pt" + joins, ["epoch_seconds", "speedup"]), "runs", ctes=ctes, recursive=True)


QUERIES["K9_write_result_tables"] = (_k9, _k9_sql())


def _a26(spark, sf):
    return round_doubles(R.series_means(_clean(spark, sf), METRIC))


SQL_SERIES = ("series AS (SELECT dataset, combination_type AS series, hidden_layer_to_use, avg(value) * 100 AS mean_pct FROM cellv "
              "WHERE NOT not_special_tokens_to_zero AND combination_type IN ('one_layer_cls', 'cutoff_layers_one_layer_cls') "
              "AND hidden_layer_to_use <= 11 GROUP BY ALL UNION ALL SELECT dataset, 'baseline', 12, base_mean * 100 FROM bstats)")

QUERIES["A26_series_means"] = (_a26, with_views(r6("SELECT * FROM series", ["mean_pct"]), "runs",
                                                ctes=[SQL_CLEAN, cellv(), base(), bstats(), SQL_SERIES]))


def _a18(spark, sf):
    c = _clean(spark, sf)
    return round_doubles(R.global_range(R.delta_matrix(c, METRIC, long=True), R.series_means(c, METRIC),
                                        R.delta_matrix(c, METRIC, long=True, half="all_layers")))


QUERIES["A18_global_range"] = (_a18, with_views(r6(
    "SELECT 'delta_matrix' AS scope, min(delta) AS min_value, max(delta) AS max_value FROM dlong UNION ALL "
    "SELECT 'delta_matrix_all_layers', min(delta), max(delta) FROM dall UNION ALL "
    "SELECT 'series', min(mean_pct), max(mean_pct) FROM series WHERE series <> 'baseline'", ["min_value", "max_value"]),
    "runs", ctes=[*SQL_DELTA, SQL_DELTA_ALL, SQL_SERIES]))


# -- time and text ----------------------------------------------------------

def _x12(spark, sf):
    r = runs(spark, sf)
    return r.select("ord", TF.duration_seconds("start_time", "end_time").alias("seconds"),
                    TF.duration_seconds("start_time", "end_time", compat=True).alias("seconds_compat"))


def _compat_secs(ts):
    t = _dur_sql(ts)
    return f"(day({t}) * 86400 + hour({t}) * 3600 + minute({t}) * 60 + second({t}))"


QUERIES["X12_duration_seconds"] = (_x12, with_views(
    f"SELECT ord, CAST(epoch({_dur_sql('end_time')}) - epoch({_dur_sql('start_time')}) AS BIGINT) AS seconds, "
    f"CAST({_compat_secs('end_time')} - {_compat_secs('start_time')} AS BIGINT) AS seconds_compat FROM runs", "runs"))


def _x13(spark, sf):
    r = runs(spark, sf).select("ord", F.floor(F.col("time_train_min") * 60 * 24).cast("long").alias("secs"))
    h = TF.hms("secs")
    return r.select("ord", "secs", h.alias("hms"),
                    F.when(~h.contains("day"), TF.hms_to_seconds(h)).alias("back"))


_HMS_SQL = ("CASE WHEN secs // 86400 = 1 THEN '1 day, ' WHEN secs // 86400 > 1 THEN CAST(secs // 86400 AS VARCHAR) || ' days, ' "
            "ELSE '' END || printf('%d:%02d:%02d', (secs % 86400) // 3600, (secs % 3600) // 60, secs % 60)")

QUERIES["X13_hms"] = (_x13, with_views(
    f"SELECT ord, secs, {_HMS_SQL} AS hms, CASE WHEN secs < 86400 THEN (secs // 3600) * 3600 + ((secs % 3600) // 60) * 60 "
    "+ secs % 60 END AS back FROM (SELECT ord, CAST(floor(time_train_min * 60 * 24) AS BIGINT) AS secs FROM runs)", "runs"))


def _x14(spark, sf):
    c = cut_lineage(_clean(spark, sf))  # tests and effects both read it
    cmp = R.compare_cells(c, METRIC)
    eff = R.cell_effects(c, METRIC).select(*R.CELL, "band")
    j = cmp.join(eff, R.CELL, "left").withColumn("delta", (F.col("mean") - F.col("base_mean")) * 100)
    is_base = (F.col(R.COMB) == "one_layer_cls") & (F.col(R.LAYER) == 12) & ~F.col(R.FLAG)
    return j.select(*R.CELL, TF.mark_result("delta", "p_value", "better", "band").alias("mark"),
                    TF.heat_text("delta", "p_value", is_base).alias("heat"))


def _x14_sql():
    def rtxt(k):
        r = sround("delta", k)
        return (f"(CASE WHEN {r} = 0 AND round(delta, 9) < 0 THEN '-' ELSE '' END || printf('%.{k}f', {r}))")
    txt = f"(CASE WHEN {sround('delta', 1)} > 0 THEN '+' ELSE '' END || {rtxt(1)})"
    mark = (f"(CASE WHEN p_value < 0.05 AND better THEN '\\bf{{' || {txt} || '}}' WHEN p_value > 0.05 AND NOT better "
            f"THEN {txt} || '*' ELSE {txt} END)")
    wrapped = (f"CASE band WHEN 'large' THEN '\\lef{{' || {mark} || '}}' WHEN 'medium' THEN '\\mef{{' || {mark} || '}}' "
               f"WHEN 'small' THEN '\\sef{{' || {mark} || '}}' ELSE {mark} END")
    heat0 = (f"(CASE WHEN {sround('delta', 1)} = 0 THEN {rtxt(2)} ELSE {rtxt(1)} END"
             " || CASE WHEN p_value < 0.05 THEN '*' ELSE '' END)")
    heat = (f"CASE WHEN combination_type = 'one_layer_cls' AND hidden_layer_to_use = 12 AND NOT not_special_tokens_to_zero "
            f"THEN 'bsln' ELSE {heat0} END")
    body = (f"SELECT {CELL_SQL}, {wrapped} AS mark, {heat} AS heat FROM (SELECT c.*, (c.mean - c.base_mean) * 100 AS delta, "
            f"e.a12, {SQL_BAND.replace('a12', 'e.a12')} AS band FROM cmp c LEFT JOIN a12t e USING ({CELL_SQL}))")
    return with_views(body, "runs", ctes=[*SQL_COMPARE, SQL_SAMPLES, SQL_A12], recursive=True)


QUERIES["X14_mark_result"] = (_x14, _x14_sql())


def _x15(spark, sf):
    r = runs(spark, sf).select("ord", (F.col("acc_test") * 1000).alias("x"))
    return r.select("ord", TF.half_even("x", 0).alias("half_even"), F.round("x", 1).alias("half_up_1"))


QUERIES["X15_rounding"] = (_x15, with_views(
    "SELECT ord, round_even(acc_test * 1000, 0) AS half_even, round(acc_test * 1000, 1) AS half_up_1 FROM runs", "runs"))
