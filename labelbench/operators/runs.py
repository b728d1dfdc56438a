"""Experiment-run analysis over a run table.

Column names (after S9 renames the dotted CSV headers): dataset, ord,
combination_type, hidden_layer_to_use, seed, epochs,
not_special_tokens_to_zero, num_trainable_parameters, start_time, end_time,
time_train_min and the metric columns (acc_test, balanced_acc_test,
f1_micro_test, f1_macro_test, f1_weighted_test).

The original analysis filters the whole table once per (cell, seed) lookup,
thousands of times; here every statistic is one ``groupBy`` over the cleaned
table, and baselines are attached with equi joins on (dataset) or
(dataset, seed).  Grouped results are cell-sized, so AQE broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import duration_seconds, hms_to_seconds, mark_result, round_text, stable
from .stats import wilcoxon_signed_rank, with_band

COMB = "combination_type"
LAYER = "hidden_layer_to_use"
FLAG = "not_special_tokens_to_zero"
CELL = ["dataset", COMB, LAYER, FLAG]
RUN_KEY = ["dataset", COMB, LAYER, "seed", "epochs", FLAG]

# The study grid.
COMBINATIONS = [
    "cutoff_layers_one_layer_cls", "one_layer_cls", "one_layer_w_sum_tokens",
    "one_layer_max_pool_tokens", "w_sum_tokens_w_sum_layers", "max_pool_layers_w_sum_tokens",
    "w_sum_layers_w_sum_tokens", "max_pool_tokens_w_sum_layers",
    "max_pool_layers_max_pool_tokens", "w_sum_cls", "max_pool_cls",
]
SEEDS = list(range(1, 10)) + [42]
EPOCHS = 10
BASELINE = ("one_layer_cls", 12, False)
CUTOFF = "cutoff_layers_one_layer_cls"
SP_SUFFIX = "_zero_out_sp_tokens"

# Display names of the combinations ({l} = layer number).
PLOT_NAMES = {
    "cutoff_layers_one_layer_cls": "(xii) {l} layers",
    "one_layer_w_sum_tokens": "(ix) w sum tokens, layer {l}",
    "one_layer_max_pool_tokens": "(v) max pool tokens, layer {l}",
    "one_layer_cls": "(ii) CLS, layer {l}",
    "w_sum_tokens_w_sum_layers": "(x) w sum tokens, w sum layers",
    "max_pool_layers_w_sum_tokens": "(vii) max pool layers, w sum tokens",
    "w_sum_layers_w_sum_tokens": "(xi) w sum layers, w sum tokens",
    "max_pool_tokens_w_sum_layers": "(viii) max pool tokens, w sum layers",
    "max_pool_layers_max_pool_tokens": "(vi) max pool layers,\nmax pool tokens",
    "w_sum_cls": "(iv) w sum CLS tokens",
    "max_pool_cls": "(iii) max pool CLS tokens",
    "baseline": "(i) baseline,\nCLS, layer 12",
    "one_layer_w_sum_tokens_zero_out_sp_tokens": "(ix) w sum tokens, layer {l},\nspecial tokens = 0",
    "one_layer_max_pool_tokens_zero_out_sp_tokens": "(v) max pool tokens, layer {l},\nspecial tokens = 0",
    "w_sum_tokens_w_sum_layers_zero_out_sp_tokens": "(x) w sum tokens, w sum layers,\nspecial tokens = 0",
    "max_pool_layers_w_sum_tokens_zero_out_sp_tokens": "(vii) max pool layers, w sum tokens,\nspecial tokens = 0",
    "w_sum_layers_w_sum_tokens_zero_out_sp_tokens": "(xi) w sum layers, w sum tokens,\nspecial tokens = 0",
    "max_pool_tokens_w_sum_layers_zero_out_sp_tokens": "(viii) max pool tokens, w sum layers,\nspecial tokens = 0",
    "max_pool_layers_max_pool_tokens_zero_out_sp_tokens": "(vi) max pool layers, max pool tokens,\nspecial tokens = 0",
}
# Row names of the heat maps.
HEATMAP_NAMES = {
    "cutoff_layers_one_layer_cls": "(xii) model with l<L layers,\n last layer CLS token",
    "one_layer_w_sum_tokens": "(ix) w sum all tokens",
    "one_layer_max_pool_tokens": "(v) max pool all tokens",
    "one_layer_w_sum_tokens_zero_out_sp_tokens": "(ix) w sum code tokens",
    "one_layer_max_pool_tokens_zero_out_sp_tokens": "(v) max pool code tokens",
    "one_layer_cls": "(ii) CLS token layer $l$",
    "w_sum_tokens_w_sum_layers": "(x) w sum all tokens, w sum layers",
    "max_pool_layers_w_sum_tokens": "(vii) max pool layers, w sum all tokens",
    "w_sum_layers_w_sum_tokens": "(xi) w sum layers, w sum all tokens",
    "max_pool_tokens_w_sum_layers": "(viii) max pool all tokens, w sum layers",
    "max_pool_layers_max_pool_tokens": "(vi) max pool layers, max pool all tokens",
    "w_sum_tokens_w_sum_layers_zero_out_sp_tokens": "(x) w sum code tokens, w sum layers",
    "max_pool_layers_w_sum_tokens_zero_out_sp_tokens": "(vii) max pool layers, w sum code tokens",
    "w_sum_layers_w_sum_tokens_zero_out_sp_tokens": "(xi) w sum layers, w sum code tokens",
    "max_pool_tokens_w_sum_layers_zero_out_sp_tokens": "(viii) max pool code tokens, w sum layers",
    "max_pool_layers_max_pool_tokens_zero_out_sp_tokens": "(vi) max pool layers, max pool code tokens",
    "w_sum_cls": "(iv) w sum CLS tokens",
    "max_pool_cls": "(iii) max pool CLS tokens",
    "baseline": "(i) baseline,\nCLS, layer 12",
}
# Row order of the all-layer matrix.
MATRIX_ORDER = [
    "max_pool_cls", "w_sum_cls",
    "max_pool_layers_max_pool_tokens", "max_pool_layers_max_pool_tokens_zero_out_sp_tokens",
    "max_pool_layers_w_sum_tokens", "max_pool_layers_w_sum_tokens_zero_out_sp_tokens",
    "max_pool_tokens_w_sum_layers", "max_pool_tokens_w_sum_layers_zero_out_sp_tokens",
    "w_sum_layers_w_sum_tokens", "w_sum_layers_w_sum_tokens_zero_out_sp_tokens",
    "w_sum_tokens_w_sum_layers", "w_sum_tokens_w_sum_layers_zero_out_sp_tokens",
]
# Dataset and metric display names.
DATASET_NAMES = {"devign": "Devign", "bifi": "BIFI", "exception": "Exception Type", "reveal": "ReVeal"}
METRIC_NAMES = {"acc_test": "accuracy", "balanced_acc_test": "balanced accuracy",
                "f1_macro_test": "F1-score macro", "f1_weighted_test": "F1 (w)", "f1_micro_test": "F1"}


# -- cleaning ---------------------------------------------------------------

def drop_missing_metric(runs: DataFrame, metric: str = "acc_test") -> DataFrame:
    """Rows with a NULL (or NaN) metric removed."""
    c = F.col(metric)
    return runs.where(c.isNotNull() & ~F.isnan(c))


def keep_last_run(runs: DataFrame, keys=tuple(RUN_KEY), order_col: str = "ord") -> DataFrame:
    """One row per key, the last in file order; NULL keys compare equal.

    ``max_by`` over a struct is a plain aggregate: partial per task, so a hot
    key is collapsed map-side instead of sorted in one window partition."""
    keys = list(keys)
    rest = [c for c in runs.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col))
    return runs.groupBy(*keys).agg(last.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def clean_runs(runs: DataFrame, metric: str = "acc_test") -> DataFrame:
    """P6 then W1, as the analysis starts."""
    return keep_last_run(drop_missing_metric(runs, metric))


# -- predicates and names ---------------------------------------------------

def family(col: str = COMB) -> dict:
    """Substring predicates choosing layers and flags."""
    c = F.col(col)
    return {"one_layer": c.contains("one_layer"), "cutoff": c.contains("cutoff"),
            "cls": c.contains("cls"), "w_sum": c.contains("w_")}


def variant_key(comb: str = COMB, flag: str = FLAG) -> Column:
    """P10: combination name + ``_zero_out_sp_tokens`` when the flag is False and
    the name has no ``cls`` (flag False means special tokens ARE zeroed)."""
    c = F.col(comb)
    return F.when(~F.col(flag) & ~c.contains("cls"), F.concat(c, F.lit(SP_SUFFIX))).otherwise(c)


def scale_100(col) -> Column:
    """P11."""
    c = F.col(col) if isinstance(col, str) else col
    return c * 100.0


def names_table(spark, names: dict = PLOT_NAMES) -> DataFrame:
    """Fixed display-name dimension (19 rows), broadcast by construction."""
    return spark.createDataFrame(list(names.items()), "variant string, template string")


def display_names(df: DataFrame, variant_col: str = "variant", layer_col: str = LAYER, names: dict = PLOT_NAMES) -> DataFrame:
    """Readable name of each (variant, layer), from the plots' or the heat maps' names."""
    t = F.broadcast(names_table(df.sparkSession, names))
    return (df.join(t, df[variant_col] == t["variant"], "left").drop(t["variant"])
            .withColumn("display_name", F.replace(F.col("template"), F.lit("{l}"),
                                                  F.col(layer_col).cast("string")))
            .drop("template"))


def metric_value(metric: str) -> Column:
    """The metric as a number; ``h:mm:ss`` strings of a ``total_time`` metric
    become seconds first (A11)."""
    if "total_time" in metric:
        return hms_to_seconds(F.col(metric)).cast("double")
    return F.col(metric)


def run_cell(runs: DataFrame, combination: str, layer: int, flag: bool, metric: str,
             epochs: int = EPOCHS) -> DataFrame:
    """P5: the rows of one cell, one metric (with seed and order kept)."""
    return (runs.where((F.col(COMB) == combination) & (F.col(LAYER) == layer)
                       & (F.col("epochs") == epochs) & (F.col(FLAG) == flag))
            .select("dataset", "seed", "ord", metric_value(metric).alias("value")))


def cell_values(clean: DataFrame, metric: str, epochs: int = EPOCHS) -> DataFrame:
    """All cells at once: (cell, seed, ord, value)."""
    return clean.where(F.col("epochs") == epochs).select(*CELL, "seed", "ord", metric_value(metric).alias("value"))


# -- grid and coverage ------------------------------------------------------

def run_grid(datasets: DataFrame) -> DataFrame:
    """O1: expected runs per dataset: seeds x combinations x layers x flags with
    the family rules (cutoff 1-11, other one-layer 1-12, all-layer 12; cls
    only with flag False).  Built by exploding literal arrays, no join."""
    combos = F.array(*[F.lit(c) for c in COMBINATIONS])
    g = (datasets.select("dataset").distinct()
         .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
         .withColumn(COMB, F.explode(combos)))
    c = F.col(COMB)
    layers = (F.when(c.contains("one_layer") & c.contains("cutoff"), F.sequence(F.lit(1), F.lit(11)))
              .when(c.contains("one_layer"), F.sequence(F.lit(1), F.lit(12)))
              .otherwise(F.array(F.lit(12))))
    flags = F.when(c.contains("cls"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    return (g.withColumn(LAYER, F.explode(layers)).withColumn(FLAG, F.explode(flags))
            .select("dataset", F.col("seed").cast("int").alias("seed"), COMB,
                    F.col(LAYER).cast("int").alias(LAYER), FLAG))


def missing_runs(runs: DataFrame, metric: str = "acc_test", epochs: int = EPOCHS) -> DataFrame:
    """Grid minus runs present with ``epochs`` and a metric value."""
    present = drop_missing_metric(runs, metric).where(F.col("epochs") == epochs) \
        .select("dataset", "seed", COMB, LAYER, FLAG).distinct()
    grid = run_grid(runs)
    return grid.join(present, ["dataset", "seed", COMB, LAYER, FLAG], "left_anti")


def seed_coverage(clean: DataFrame, epochs: int = EPOCHS, expected: int = 10) -> DataFrame:
    """Cells whose value count is not ``expected`` or that hold seeds outside
    {1..9, 42}."""
    cells = clean.where(F.col("epochs") == epochs).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.array_sort(F.array_except(F.collect_set("seed"), F.array(*[F.lit(s) for s in SEEDS]))).alias("__u"))
    return (cells.where((F.col("n_values") != expected) | (F.size("__u") > 0))
            .select(*CELL, "n_values", F.array_join("__u", ",").alias("unknown_seeds")))


# -- cell statistics and baselines ------------------------------------------

def cell_stats(clean: DataFrame, metric: str, epochs: int = EPOCHS) -> DataFrame:
    """Mean, max and count of a metric per cell over seeds."""
    v = cell_values(clean, metric, epochs)
    return v.groupBy(*CELL).agg(F.avg("value").alias("mean"), F.max("value").alias("max"),
                                F.count("value").alias("n"))


def baseline_values(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """J5 (pairs): baseline value per (dataset, seed)."""
    comb, layer, flag = baseline
    return run_cell(clean, comb, layer, flag, metric, epochs).select(
        "dataset", "seed", F.col("value").alias("base"))


def baseline_stats(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """J5 (means): baseline mean and max per dataset."""
    b = baseline_values(clean, metric, epochs, baseline)
    return b.groupBy("dataset").agg(F.avg("base").alias("base_mean"), F.max("base").alias("base_max"),
                                    F.count("base").alias("base_n"))


def _is_baseline(baseline=BASELINE) -> Column:
    comb, layer, flag = baseline
    return (F.col(COMB) == comb) & (F.col(LAYER) == layer) & F.col(FLAG).eqNullSafe(F.lit(flag))


def cells_with_baseline(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """A9 with J5: cell statistics and those of the dataset's baseline cell, from one pass over the
    runs; datasets without baseline runs drop out.  The window sees the cells of a dataset."""
    of = Window.partitionBy("dataset")
    mine = _is_baseline(baseline)
    out = cell_stats(clean, metric, epochs).withColumn("__has", F.max(F.when(mine, 1)).over(of))
    for name, src in (("base_mean", "mean"), ("base_max", "max"), ("base_n", "n")):
        out = out.withColumn(name, F.max(F.when(mine, F.col(src))).over(of))
    return out.where("__has = 1").drop("__has")


def paired_with_baseline(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """Cell values with the baseline value of the same (dataset, seed) and their difference, NULL
    where there is none.  The window sees one row per cell."""
    v = cell_values(clean, metric, epochs)
    base = F.max(F.when(_is_baseline(baseline), F.col("value"))).over(Window.partitionBy("dataset", "seed"))
    return v.withColumn("base", base).withColumn("d", F.col("value") - F.col("base"))


def cell_tests(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """A16 per cell against the baseline, paired by seed.  Every cell gets a
    row; a cell sharing no seed with the baseline has n = 0 and no p-value
    (the original's "n/a")."""
    t = wilcoxon_signed_rank(paired_with_baseline(clean, metric, epochs, baseline), CELL, "d")
    some = F.col("n") + F.col("n_zero") > 0
    return t.withColumns({c: F.when(some, F.col(c)) for c in ("w_plus", "w_minus", "t_stat")})


def _against_baseline(clean: DataFrame, value: Column, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """Every pair of (cell, value), with its count, and where the value stands among the baseline's
    values of the dataset: ``below`` and ``same`` baseline values, ``of`` baseline values in all.

    Cells and baseline are value counts of one pass over the runs, and a running sum over a
    dataset's distinct values places all cells at once; no baseline row is copied to a cell."""
    is_base = _is_baseline(baseline)
    counts = clean.where(F.col("epochs") == epochs).select(*CELL, value.alias("value")).where("value is not null") \
                  .groupBy(*CELL, "value").agg(F.count(F.lit(1)).alias("n"))
    at_value = Window.partitionBy("dataset").orderBy("value")
    base = F.when(is_base, F.col("n")).otherwise(0)
    ranked = (counts.withColumn("__upto", F.sum(base).over(at_value.rangeBetween(Window.unboundedPreceding, 0)))
              .withColumn("same", F.sum(base).over(Window.partitionBy("dataset", "value")))
              .withColumn("of", F.sum(base).over(Window.partitionBy("dataset"))))
    return ranked.select(*CELL, "value", "n", (F.col("__upto") - F.col("same")).alias("below"), "same", "of")


def cell_effects(clean: DataFrame, metric: str | Column, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """A17 per cell: cell values against the baseline values of the dataset, undirected A12 =
    max(s, 1 - s) with s = P(x > y) + P(x = y) / 2.  ``metric`` is a column name or an
    expression, such as the duration in seconds between start and end."""
    value = metric_value(metric) if isinstance(metric, str) else metric
    placed = _against_baseline(clean, value, epochs, baseline)
    sums = placed.groupBy(*CELL).agg(F.sum("n").alias("n1"), F.max("of").alias("n2"),
                                     F.sum(F.col("n") * (2 * F.col("below") + F.col("same"))).alias("halves"))
    s = F.try_divide(F.col("halves").cast("double"), 2.0 * F.col("n1") * F.col("n2"))
    return with_band(sums.withColumn("a12", F.greatest(s, 1 - s))).select(
        *CELL, F.col("n1").cast("int").alias("n1"), F.col("n2").cast("int").alias("n2"), "a12", "band")


def run_seconds() -> Column:
    """Seconds from a run's start to its end, as a metric of A17."""
    return duration_seconds("start_time", "end_time").cast("double")


def cell_pair_counts(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """Per cell the pairs (cell value, baseline value) with the first larger, equal ones, and all."""
    placed = _against_baseline(clean, metric_value(metric), epochs, baseline)
    return placed.groupBy(*CELL).agg(F.sum(F.col("n") * F.col("below")).alias("more"), F.sum(F.col("n") * F.col("same")).alias("same"),
                                     F.sum(F.col("n") * F.col("of")).alias("pairs"))


def reduced_models(clean: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The combined table of the reduced models over all datasets: per (dataset, layer) the mean
    training time of an epoch and its effect band, the speed-up, and accuracy and weighted F1 as marked
    differences to the baseline (X14) wrapped in their effect bands; layer 12 is the baseline."""
    table = pruned_table(clean, ("acc_test", "f1_weighted_test"), epochs=epochs)
    mine = (F.col(COMB) == CUTOFF) & ~F.col(FLAG)
    out = table.select("dataset", LAYER, "epoch_seconds", "speedup", "diff_acc", "p_acc", "diff_f1_weighted", "p_f1_weighted")
    for name, metric in (("time", run_seconds()), ("acc", "acc_test"), ("f1_weighted", "f1_weighted_test")):
        band = cell_effects(clean, metric, epochs).where(mine).select("dataset", LAYER, F.col("band").alias(f"band_{name}"))
        out = out.join(band, ["dataset", LAYER], "left")
    for name in ("acc", "f1_weighted"):
        better = F.col(f"diff_{name}") > 0
        mark = mark_result(f"diff_{name}", f"p_{name}", better, f"band_{name}")
        out = out.withColumn(name, F.when(F.col(LAYER) < 12, mark).otherwise(round_text(f"diff_{name}", 1)))
    return out.select("dataset", LAYER, "epoch_seconds", "speedup", "acc", "f1_weighted", "band_time")


def compare_cells(clean: DataFrame, metric: str, epochs: int = EPOCHS, baseline=BASELINE) -> DataFrame:
    """P7/P8 base: cell mean vs baseline mean with the Wilcoxon p-value."""
    st = cells_with_baseline(clean, metric, epochs, baseline)
    t = cell_tests(clean, metric, epochs, baseline).select(*CELL, "p_value")
    return st.join(t, CELL, "left").withColumn("better", stable("mean") > stable("base_mean"))


def better_than_baseline(clean: DataFrame, metric: str, epochs: int = EPOCHS) -> DataFrame:
    """Cells whose mean is strictly above the baseline mean, with p (NULL = n/a)."""
    return compare_cells(clean, metric, epochs).where("better").select(*CELL, "mean", "base_mean", "p_value")


def all_cells_with_p(clean: DataFrame, metric: str, epochs: int = EPOCHS) -> DataFrame:
    """Every cell; p only where the mean beats the baseline mean."""
    c = compare_cells(clean, metric, epochs)
    return c.select(*CELL, "mean", "base_mean", F.when(F.col("better"), F.col("p_value")).alias("p_value"))


def _half(half: str) -> tuple[Column, list[int]]:
    """Which cells belong to a half of the result matrices, and its layers."""
    one = F.col(COMB).contains("one_layer")
    if half == "one_layer":
        return one & ~F.col(COMB).contains("cutoff"), list(range(1, 13))
    if half == "all_layers":
        return ~one & (F.col(LAYER) == 12), [12]
    raise ValueError(f"unknown half {half!r}")


def delta_matrix(clean: DataFrame, metric: str, epochs: int = EPOCHS, long: bool = False, half: str = "one_layer") -> DataFrame:
    """A10: (cell stat - baseline stat) x 100 for stat in {max, mean}, pivoted variant x
    layer.  ``half``: the one-layer, non-cutoff combinations (l1..l12), or the combinations
    over all layers, which stand at layer 12 (l12)."""
    mine, layers = _half(half)
    j = cells_with_baseline(clean, metric, epochs).where(mine).withColumn("variant", variant_key())
    lg = j.select("dataset", "variant", LAYER, F.explode(F.array(
        F.struct(F.lit("max").alias("stat"), ((F.col("max") - F.col("base_max")) * 100).alias("delta")),
        F.struct(F.lit("mean").alias("stat"), ((F.col("mean") - F.col("base_mean")) * 100).alias("delta"))
    )).alias("r")).select("dataset", "r.stat", "variant", LAYER, "r.delta")
    if long:
        return lg
    lg = lg.withColumn("__l", F.concat(F.lit("l"), F.col(LAYER).cast("string")))
    return lg.groupBy("dataset", "stat", "variant").pivot("__l", [f"l{i}" for i in layers]).agg(
        F.first("delta"))


def pvalue_matrix(clean: DataFrame, metric: str, epochs: int = EPOCHS, half: str = "one_layer") -> DataFrame:
    """A10 companion: the Wilcoxon p-value of every cell of a half against the baseline,
    in the same variant x layer shape."""
    mine, layers = _half(half)
    t = cell_tests(clean, metric, epochs).where(mine)
    t = t.select("dataset", variant_key().alias("variant"),
                 F.concat(F.lit("l"), F.col(LAYER).cast("string")).alias("__l"), "p_value")
    return t.groupBy("dataset", "variant").pivot("__l", [f"l{i}" for i in layers]).agg(F.first("p_value"))


def best_cell(delta_long: DataFrame, part=("dataset", "stat")) -> DataFrame:
    """Greatest delta with every (variant, layer) that reaches it (rank keeps ties)."""
    w = Window.partitionBy(*part).orderBy(F.desc("delta"))
    return delta_long.where(F.col("delta").isNotNull()).withColumn("__rk", F.rank().over(w)) \
        .where("__rk = 1").drop("__rk")


def ordered_output(df: DataFrame, order: list[str], key: str = "variant") -> DataFrame:
    """T4: rows in an explicit order given as a list; unknown keys last."""
    t = F.broadcast(df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)],
                                                    f"{key} string, row_rank int"))
    return df.join(t, key, "left").orderBy(F.col("row_rank").asc_nulls_last(), key)


def percent_of_baseline(clean: DataFrame, metric: str, combination: str = CUTOFF,
                        epochs: int = EPOCHS, expected: int = 10, flag: bool = False) -> DataFrame:
    """mean(values) / mean(baseline) x 100 per (dataset, layer); NULL (n/a)
    unless the cell has exactly ``expected`` values."""
    st = cells_with_baseline(clean, metric, epochs).where((F.col(COMB) == combination) & (F.col(FLAG) == flag))
    return st.select(
        "dataset", LAYER, "n",
        F.when(F.col("n") == expected, F.try_divide(F.col("mean"), F.col("base_mean")) * 100).alias("pct"))


def param_overhead(clean: DataFrame, combinations=("w_sum_tokens_w_sum_layers", "one_layer_w_sum_tokens"),
                   layer: int = 12, flag: bool = False, epochs: int = EPOCHS) -> DataFrame:
    """(mean parameters - baseline mean) / baseline mean x 100 per combination;
    layer and flag are arguments (the original mixes them up)."""
    st = cells_with_baseline(clean, "num_trainable_parameters", epochs).where(
        F.col(COMB).isin(list(combinations)) & (F.col(LAYER) == layer) & (F.col(FLAG) == flag))
    return st.select(
        "dataset", COMB, F.col("mean").alias("mean_params"), F.col("base_mean").alias("baseline_params"),
        (F.try_divide(F.col("mean") - F.col("base_mean"), F.col("base_mean")) * 100).alias("diff_pct"))


def duration_table(clean: DataFrame, combination: str = CUTOFF, epochs: int = EPOCHS,
                   flag: bool = False, compat: bool = False) -> DataFrame:
    """Mean total seconds (end - start) and mean train seconds per epoch per
    (dataset, layer), the baseline row at layer 12."""
    c = clean.where((F.col("epochs") == epochs) & (F.col(FLAG) == flag)
                    & (((F.col(COMB) == combination) & (F.col(LAYER) < 12))
                       | ((F.col(COMB) == BASELINE[0]) & (F.col(LAYER) == BASELINE[1]))))
    return c.groupBy("dataset", LAYER).agg(
        F.avg(duration_seconds("start_time", "end_time", compat)).alias("total_seconds"),
        F.avg(F.col("time_train_min") * 60.0).alias("epoch_seconds"))


def speedup(clean: DataFrame, combination: str = CUTOFF, epochs: int = EPOCHS, flag: bool = False,
            durations: DataFrame | None = None) -> DataFrame:
    """Baseline mean train time / cell mean train time, 1 decimal
    (``durations``: an A14 table already computed)."""
    d = durations if durations is not None else duration_table(clean, combination, epochs, flag)
    b = d.where(F.col(LAYER) == 12).select("dataset", F.col("epoch_seconds").alias("__b"))
    return d.join(b, "dataset").select("dataset", LAYER, F.round(stable(F.try_divide(F.col("__b"), F.col("epoch_seconds"))), 1)
                                       .alias("speedup"))


def pruned_table(clean: DataFrame, metrics=("acc_test", "balanced_acc_test", "f1_micro_test", "f1_weighted_test"),
                 combination: str = CUTOFF, epochs: int = EPOCHS, flag: bool = False,
                 expected: int = 10) -> DataFrame:
    """Per dataset and layer 12..1 - parameter %, times, speed-up and per
    metric the difference to the baseline in points (round(mean*100, 1) -
    round(base*100, 2), rounded to 1) with the Wilcoxon p-value; layer 12 holds
    the baseline values.  Numbers only; text is X14's job.

    Every quantity is a "metric" of one long table (the reduced models at
    layers 1..11 and the baseline at layer 12), read once: a window pairs the values with
    the baseline's of the same seed, one aggregate per (dataset, layer, metric) gives means and
    tests, a window over its rows brings the baseline's mean, and one pivot the columns."""
    comb, blayer, bflag = BASELINE
    is_base = (F.col(COMB) == comb) & (F.col(LAYER) == blayer) & (F.col(FLAG) == bflag)
    rows = clean.where((F.col("epochs") == epochs)
                       & (((F.col(COMB) == combination) & (F.col(FLAG) == flag) & (F.col(LAYER) < 12)) | is_base))
    shorts = [m.replace("_test", "") for m in metrics]
    items = [F.struct(F.lit(sh).alias("metric"), F.col(m).cast("double").alias("value")) for sh, m in zip(shorts, metrics)]
    items += [F.struct(F.lit("params").alias("metric"), F.col("num_trainable_parameters").cast("double").alias("value")),
              F.struct(F.lit("epoch_seconds").alias("metric"), (F.col("time_train_min") * 60.0).alias("value")),
              F.struct(F.lit("total_seconds").alias("metric"),
                       duration_seconds("start_time", "end_time").cast("double").alias("value"))]
    long = rows.select("dataset", LAYER, "seed", is_base.alias("__base"), F.explode(F.array(*items)).alias("r")) \
               .select("dataset", LAYER, "seed", "__base", "r.metric", "r.value")
    base_here = F.max(F.when(F.col("__base"), F.col("value"))).over(Window.partitionBy("dataset", "seed", "metric"))
    pairs = long.withColumn("d", F.when(~F.col("__base"), F.col("value") - base_here))
    # one row per (dataset, layer, metric): mean, count and test; layer 12 is the baseline itself
    cells = wilcoxon_signed_rank(pairs, ["dataset", LAYER, "metric"], "d", value_col="value").select(
        "dataset", LAYER, "metric", F.col("value_mean").alias("m"), F.col("value_n").alias("n"), "p_value")
    own = F.col(LAYER) == blayer
    cells = cells.withColumn("b", F.max(F.when(own, F.col("m"))).over(Window.partitionBy("dataset", "metric")))
    met = F.col("metric")
    val = (F.when(met == "params", F.when(own, F.col("b")).when(
               F.col("n") == expected, F.round(stable(F.try_divide(F.col("m"), F.col("b")) * 100), 0)))
           .when(met.isin("epoch_seconds", "total_seconds"), F.col("m"))
           .when(own, F.round(stable(F.col("b") * 100), 2))
           .otherwise(F.round(stable(F.round(stable(F.col("m") * 100), 1) - F.round(stable(F.col("b") * 100), 2)), 1)))
    allrows = cells.select("dataset", LAYER, "metric", val.alias("v"), "p_value",
                           F.when(met == "epoch_seconds", F.round(stable(F.try_divide(F.col("b"), F.col("m"))), 1)).alias("speed"))
    names = ["params", "total_seconds", "epoch_seconds", *shorts]
    wide = allrows.groupBy("dataset", LAYER).pivot("metric", names).agg(
        F.first("v").alias("v"), F.first("p_value").alias("p"), F.first("speed").alias("s"))
    cols = [F.col("params_v").alias("params_pct"), F.col("total_seconds_v").alias("total_seconds"),
            F.col("epoch_seconds_v").alias("epoch_seconds"), F.col("epoch_seconds_s").alias("speedup")]
    for sh in shorts:
        cols += [F.col(f"{sh}_v").alias(f"diff_{sh}"), F.col(f"{sh}_p").alias(f"p_{sh}")]
    # the original's row order: per dataset, layer 12 (baseline) down to 1
    return wide.select("dataset", LAYER, *cols).orderBy("dataset", F.desc(LAYER))


def series_means(clean: DataFrame, metric: str = "acc_test", epochs: int = EPOCHS, flag: bool = False) -> DataFrame:
    """Mean metric x 100 per layer 1-11 for the full-size and cutoff
    one-layer CLS variants, plus the baseline at layer 12."""
    v = cell_values(clean, metric, epochs).where(F.col(FLAG) == flag)
    s = (v.where(F.col(COMB).isin("one_layer_cls", CUTOFF) & (F.col(LAYER) <= 11))
         .groupBy("dataset", F.col(COMB).alias("series"), LAYER).agg((F.avg("value") * 100).alias("mean_pct")))
    b = baseline_stats(clean, metric, epochs).select(
        "dataset", F.lit("baseline").alias("series"), F.lit(12).alias(LAYER),
        (F.col("base_mean") * 100).alias("mean_pct"))
    return s.unionByName(b)


def global_range(delta_long: DataFrame, series: DataFrame, all_layers_long: DataFrame | None = None) -> DataFrame:
    """Min and max over all matrix cells of all datasets (colour scale), of the one-layer
    half and of the all-layer half, and over the one-layer / cutoff series."""
    def fold(long, scope):
        return long.agg(F.lit(scope).alias("scope"), F.min("delta").alias("min_value"), F.max("delta").alias("max_value"))
    a = fold(delta_long, "delta_matrix")
    if all_layers_long is not None:
        a = a.unionByName(fold(all_layers_long, "delta_matrix_all_layers"))
    b = series.where(F.col("series") != "baseline").agg(
        F.lit("series").alias("scope"), F.min("mean_pct").alias("min_value"), F.max("mean_pct").alias("max_value"))
    return a.unionByName(b)
