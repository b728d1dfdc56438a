"""Dataset splits.

Seeded "shuffles" are md5 keys: ``md5(concat_ws('|', seed, id))`` orders the
rows of a class the same way on any partitioning, in Spark and in SQL.

The stratified splits (W2, W5, J2) select instead of ranking: a class is cut at the row whose rank
is its quota, so only that row's (key, id) is needed.  Counts per (class, first digits of the
key) tell where it stands, digit by digit, the few rows that are left are ranked, and
the rows themselves are compared with their class's border where they are: no row with its
text is shuffled.  Batches (W6, W7) need every rank; those use the two-phase rank (operators.rank),
so a class holding a third of all rows is still spread over thousands of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rank import hex_bucket, null_safe_keys, two_phase_row_number, with_keys


#: Classes up to which a split's counts come to the driver (256 for each) and its borders are broadcast; digits that a
#: count looks at; rows with equal digits up to which they are ranked.
MOST_CLASSES, DIGITS, RANKED_ROWS = 1000, 2, 1_000_000


def seeded_key(seed, id_col: str, *salt) -> Column:
    """md5 hex of ``seed|[salt|]id``: the membership order of every seeded split."""
    parts = [F.lit(str(seed)), *[F.lit(str(s)) for s in salt], F.col(id_col).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def _largest_remainder(counts: DataFrame, label_col: str, cnt_col: str, n_draws: Column,
                       total: Column, out: str) -> DataFrame:
    """Quota per class: floor of cnt*n_draws/total, then +1 by largest remainder
    (ties by label order) until the quotas sum to n_draws.  Integer arithmetic
    only, so no float ties.  ``counts`` is the small per-class table."""
    # cnt * n_draws is up to n^2: exact in decimal(38,0), not in a long.
    c = (counts.withColumn("__num", F.col(cnt_col).cast("decimal(38,0)") * n_draws.cast("decimal(38,0)"))
         .withColumn("__tot", total.cast("decimal(38,0)"))
         .withColumn("__fl", F.expr("__num div __tot").cast("long"))
         .withColumn("__rem", F.expr("__num % __tot"))
         .drop("__num", "__tot"))
    every = Window.partitionBy()  # class table only: one row per label
    c = c.withColumn("__need", n_draws - F.sum("__fl").over(every))
    w = Window.orderBy(F.desc("__rem"), F.asc(label_col))
    c = c.withColumn("__r", F.row_number().over(w))
    return (c.withColumn(out, (F.col("__fl") + F.when(F.col("__r") <= F.col("__need"), 1)
                               .otherwise(0)).cast("long"))
            .drop("__fl", "__rem", "__need", "__r"))


def _problem(label_n: str, side_a: str, side_b: str, what: str) -> Column:
    """What forbids the split, or NULL: a class with fewer than 2 rows, or a side smaller than the number of classes."""
    few = F.lit(f"stratified split: a class has fewer than 2 rows{what}")
    small = [F.lit(f"stratified split: {side[2:]} side smaller than the number of classes") for side in (side_a, side_b)]
    return (F.when(F.col(label_n) < 2, few).when(F.col(side_a) < F.col("n_classes"), small[0])
            .when(F.col(side_b) < F.col("n_classes"), small[1]))


def _quota_stage(class_counts: DataFrame, label_col: str, n_col: str, test_size: float,
                 first: str, out: str, what: str = "") -> DataFrame:
    """Quota of the first side (``out``) per class for one stratified cut of
    ``class_counts(label, n_col)`` (rule 2.12.2), and the first ``problem`` so far."""
    every = Window.partitionBy()  # class table only: one row per label
    c = (class_counts.withColumn("n_all", F.sum(n_col).over(every))
         .withColumn("n_classes", F.count(F.lit(1)).over(every))
         .withColumn("n_second", F.ceil(F.lit(float(test_size)) * F.col("n_all")).cast("long"))
         .withColumn(f"n_{first}", F.col("n_all") - F.col("n_second")))
    q = _largest_remainder(c, label_col, n_col, F.col(f"n_{first}"), F.col("n_all"), out)
    earlier = [F.col("problem")] if "problem" in class_counts.columns else []
    q = q.withColumn("problem", F.coalesce(*earlier, _problem(n_col, f"n_{first}", "n_second", what)))
    return q.drop("n_all", "n_classes", "n_second", f"n_{first}")


def _checked(side: Column, problem: Column) -> Column:
    """The side, or the problem as an error; it sits in the column that is read, so it cannot be pruned from it."""
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(side)


def _ranked(df: DataFrame, label_col: str, id_col: str, seed, bucket_digits: int, quota_fn):
    """Rows with their 1-based rank ``__rn`` inside the class (md5 order) and the
    class quotas, in one plan:

    * counts per (label, bucket) - one partial aggregation over the input;
    * bucket offsets by a window inside each label; quotas on the class table, whose
      windows see one row per label;
    * ``row_number`` per (label, bucket), then ONE join with the small
      (label, bucket) table on the keys the rows are already partitioned by,
      so the rows themselves are shuffled exactly once.
    """
    # NULL is a class of its own: join and window keys are (is-null, value), so
    # an equi-join never drops such rows and the rows are still shuffled once
    keys = null_safe_keys(df, [label_col])
    names = [k for k, _ in keys]
    keyed = with_keys(df.withColumn("__key", seeded_key(seed, id_col))
                      .withColumn("__bucket", hex_bucket("__key", bucket_digits)), keys)
    counts = keyed.groupBy(label_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(label_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = with_keys(counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_off), F.lit(0))).drop("__n"), keys).drop(label_col)
    quotas = quota_fn(counts.groupBy(label_col).agg(F.sum("__n").alias("n_class")))
    offsets = offsets.join(with_keys(quotas, keys).drop(label_col, "n_class"), names)
    w = Window.partitionBy(*names, "__bucket").orderBy("__key", id_col)
    ranked = keyed.withColumn("__rn_local", F.row_number().over(w))
    return (ranked.join(offsets, [*names, "__bucket"])
            .withColumn("__rn", F.col("__off") + F.col("__rn_local"))
            .drop("__key", "__bucket", "__off", "__rn_local", *names))


def quotas(counts: dict, test_size: float, first: str, what: str = "") -> tuple[dict, dict]:
    """The rule of ``_quota_stage`` for class counts on the driver: ({class: quota}, {class: problem or None})."""
    total = sum(counts.values())
    second = math.ceil(float(test_size) * total)
    draws = total - second
    quota = {k: n * draws // total for k, n in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * draws % total), k is not None, k))
    for k in order[:draws - sum(quota.values())]:
        quota[k] += 1
    side = next((f"stratified split: {name} side smaller than the number of classes" for name, n in ((first, draws), ("second", second)) if n < len(counts)), None)
    return quota, {k: f"stratified split: a class has fewer than 2 rows{what}" if n < 2 else side for k, n in counts.items()}


def _borders(df: DataFrame, label_col: str, id_col: str, seed, cuts_of, most: int, ranked_rows: int):
    """The (key, id) of the last row before each cut of each class, as rows (label, problem, border of cut 0, of cut 1, ...); a
    border is NULL where the cut is at 0.  None if there are more than ``most`` classes, or if rows that share
    their id stand on both sides of a cut, which no comparison can tell apart.

    Selection by digits, over the label and id columns alone: counts by the first digits of the key tell in which of them a cut
    lies; those are counted by their next digits, until one holds at most ``ranked_rows`` rows.  These are
    ranked, and the border and the row behind it come back."""
    keys = null_safe_keys(df, [label_col])
    names = [k for k, _ in keys]
    keyed = df.select(label_col, id_col, seeded_key(seed, id_col).alias("__key"))
    by = keyed.groupBy(label_col, hex_bucket("__key", DIGITS).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    found: dict = {}
    for r in by.limit(most * 16 ** DIGITS + 1).collect():
        found.setdefault(r[0], []).append((r["at"], r.n))
    if len(found) > most:
        return None
    problems, cuts = cuts_of({label: sum(n for _, n in own) for label, own in found.items()})
    border: dict = {(label, i): None for label, at in cuts.items() for i in range(len(at))}
    open_ = {(label, i): (c, found[label]) for label, at in cuts.items() for i, c in enumerate(at) if c > 0}
    length = 0
    while open_:
        length += DIGITS
        inside = []  # (class, cut, digits, rows before the cut in them, their rows)
        for (label, i), (need, own) in open_.items():
            for digits, n in sorted(own):
                if need <= n:
                    break
                need -= n
            if need == n:
                border[label, i] = digits + "~", None  # behind every key with these digits
            else:
                inside.append((label, i, digits, need, n))
        if not inside:
            break
        if length + DIGITS > 32:
            return None
        schema = T.StructType([T.StructField(label_col, df.schema[label_col].dataType), T.StructField("cut", T.IntegerType()),
                               T.StructField("at", T.StringType()), T.StructField("need", T.LongType()), T.StructField("n", T.LongType())])
        wanted = with_keys(df.sparkSession.createDataFrame(inside, schema), keys).select(*names, "cut", "at", "need")
        rows = with_keys(keyed, keys).withColumn("at", hex_bucket("__key", length)).join(F.broadcast(wanted), [*names, "at"])
        if max(x[4] for x in inside) <= ranked_rows:
            rank = F.row_number().over(Window.partitionBy(*names, "cut").orderBy("__key", id_col))
            ends = rows.withColumn("rank", rank - F.col("need")).where("rank = 0 or rank = 1")
            last: dict = {}
            for r in ends.select(label_col, "cut", "rank", "__key", id_col).collect():
                last.setdefault((r[0], r.cut), {})[r["rank"]] = r["__key"], r[4]
            if any(v[0] == v[1] for v in last.values()):
                return None
            border |= {k: v[0] for k, v in last.items()}
            break
        deeper: dict = {}
        for r in rows.groupBy(label_col, "cut", hex_bucket("__key", length + DIGITS).alias("next")).agg(F.count(F.lit(1)).alias("n")).collect():
            deeper.setdefault((r[0], r.cut), []).append((r.next, r.n))
        open_ = {(label, i): (need, deeper[label, i]) for label, i, _, need, _ in inside}
    return [(label, problems[label], *[border[label, i] for i in range(len(at))]) for label, at in cuts.items()]


def _divide(df: DataFrame, label_col: str, id_col: str, seed, cuts_of, quota_fn, ranked_cuts: list[Column], names, out: str, bucket_digits: int,
            most: int, ranked_rows: int) -> DataFrame:
    """Adds ``out``: ``names[i]`` for the rows before cut i of their class (and not before an earlier one), the last name behind all."""
    borders = _borders(df, label_col, id_col, seed, cuts_of, most, ranked_rows)
    if borders is None:
        ranked = _ranked(df, label_col, id_col, seed, bucket_digits, quota_fn)
        side = F.lit(names[-1])
        for c, name in reversed(list(zip(ranked_cuts, names))):
            side = F.when(F.col("__rn") <= c, F.lit(name)).otherwise(side)
        return ranked.withColumn(out, _checked(side, F.col("problem"))).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
    key = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", df.schema[id_col].dataType)])
    schema = T.StructType([T.StructField(label_col, df.schema[label_col].dataType), T.StructField("__problem", T.StringType()), *[T.StructField(f"__t{i}", key) for i in range(len(names) - 1)]])
    keys = null_safe_keys(df, [label_col])
    table = with_keys(df.sparkSession.createDataFrame(borders, schema), keys).drop(label_col)
    joined = with_keys(df, keys).join(F.broadcast(table), [k for k, _ in keys])  # one row for each class, at most ``most``
    own, side = F.struct(seeded_key(seed, id_col).alias("key"), F.col(id_col).alias("id")), F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        side = F.when(F.coalesce(own <= F.col(f"__t{i}"), F.lit(False)), F.lit(name)).otherwise(side)
    return joined.withColumn(out, _checked(side, F.col("__problem"))).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float,
                     seed: int = 42, names=("train", "test"), out: str = "split",
                     bucket_digits: int = 4, most_classes: int = MOST_CLASSES, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Exact per-class quotas, seeded membership; adds column ``out``.

    The borders are found when this is called (a job or two over the label and id columns); a class that cannot
    be split is an error when the sides are read.  With more than ``most_classes`` classes, too many to
    broadcast, all rows are ranked, in buckets of ``bucket_digits`` digits."""
    def cuts_of(counts):
        quota, problems = quotas(counts, test_size, "train")
        return problems, {k: [q] for k, q in quota.items()}

    def by_table(cw):
        return _quota_stage(cw, label_col, "n_class", test_size, "train", "q_train")

    return _divide(df, label_col, id_col, seed, cuts_of, by_table, [F.col("q_train")], names, out, bucket_digits, most_classes, ranked_rows)


def three_way_split(df: DataFrame, label_col: str, id_col: str, ratio_train: float = 0.8,
                    ratio_valid: float = 0.1, ratio_test: float = 0.1, seed: int = 42,
                    out: str = "split", bucket_digits: int = 4, most_classes: int = MOST_CLASSES, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Train vs rest (test_size = 1 - ratio_train), then rest into valid/test
    (test_size = ratio_test / (ratio_test + ratio_valid)), both stratified.

    One class table serves both stages: the rest of a class is its rows behind the train quota, in the
    same key order, so a class has two borders."""
    t1 = 1.0 - ratio_train
    t2 = ratio_test / (ratio_test + ratio_valid)

    def cuts_of(counts):
        train, problems = quotas(counts, t1, "train")
        valid, later = quotas({k: n - train[k] for k, n in counts.items()}, t2, "valid", " in the rest")
        return {k: problems[k] or later[k] for k in counts}, {k: [train[k], train[k] + valid[k]] for k in counts}

    def by_table(cw):
        q1 = _quota_stage(cw, label_col, "n_class", t1, "train", "q_train")
        rest = q1.withColumn("n_rest", F.col("n_class") - F.col("q_train"))
        return _quota_stage(rest, label_col, "n_rest", t2, "valid", "q_valid", " in the rest").drop("n_rest")

    ranked_cuts = [F.col("q_train"), F.col("q_train") + F.col("q_valid")]
    return _divide(df, label_col, id_col, seed, cuts_of, by_table, ranked_cuts, ("train", "valid", "test"), out, bucket_digits, most_classes, ranked_rows)


def positional_clusters(df: DataFrame, ord_col: str = "ord", n: int | None = None,
                        n_clusters: int = 5) -> DataFrame:
    """Cluster size c = n // 5 + 1 over the stored dense position ``ord``;
    clusters 0-2 form the train pool, 3-4 the test split (the last may be short
    or empty).  Without ``n`` the rows are counted by a scalar subquery of the plan; no
    global sort is needed."""
    total = df.agg(F.count(F.lit(1))).scalar() if n is None else F.lit(n)
    size = F.floor(total / F.lit(n_clusters)) + 1
    cl = F.floor(F.col(ord_col) / size).cast("int")
    return (df.withColumn("cluster", cl)
            .withColumn("part", F.when(F.col("cluster") <= 2, F.lit("pool")).otherwise(F.lit("test"))))


def zip_by_position(a: DataFrame, b: DataFrame, pos_col: str = "ord") -> DataFrame:
    """Two sequences paired by position (both carry a dense position)."""
    return a.join(b, pos_col, "inner")


def cluster_split(df: DataFrame, label_col: str, id_col: str, ord_col: str = "ord", ratio_train: float = 0.9,
                  seed: int = 42, n: int | None = None, out: str = "split") -> DataFrame:
    """W3 + W2 (J2): positional clusters 0-2 form the pool, split stratified into
    train / valid (test_size = 1 - ratio_train); clusters 3-4 are the test split.  A row's side follows from its
    own id, as if it were looked up in the train ids."""
    c = positional_clusters(df, ord_col, n)
    pool = c.where(F.col("part") == "pool").drop("part", "cluster")
    labelled = stratified_split(pool, label_col, id_col, 1.0 - ratio_train, seed, ("train", "valid"), out)
    test = c.where(F.col("part") == "test").drop("part", "cluster").withColumn(out, F.lit("test"))
    return labelled.unionByName(test)


def split_by_index(examples: DataFrame, index: DataFrame, ord_col: str = "ord") -> DataFrame:
    """An example goes to every split whose index list holds its position.

    ``index`` is ``(ord, split)`` - the index files read by S5 with a split
    column; it is a plain equi join (Spark picks broadcast or sort-merge)."""
    return examples.join(index.select(ord_col, "split").distinct(), ord_col, "inner")


def split_by_id(pool: DataFrame, train_ids: DataFrame, id_col: str = "ex_id",
                out: str = "split") -> DataFrame:
    """``train`` when the id is in the train id set, else ``valid``."""
    ids = train_ids.select(F.col(id_col).alias("__tid")).distinct()
    return (pool.join(ids, pool[id_col] == ids["__tid"], "left")
            .withColumn(out, F.when(F.col("__tid").isNotNull(), F.lit("train"))
                        .otherwise(F.lit("valid")))
            .drop("__tid"))


def first_rows_per_split(df: DataFrame, k_by_split: dict | int, split_col: str = "split",
                         ord_col: str = "ord") -> DataFrame:
    """The first ``k`` rows of each split in stored order.

    ``row_number() <= k`` lets Spark put a per-partition group limit before the
    shuffle, so each task ships at most k rows per split."""
    w = Window.partitionBy(split_col).orderBy(ord_col)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    if isinstance(k_by_split, int):
        cond = F.col("__rn") <= k_by_split
    else:
        kmap = F.create_map(*[x for kv in k_by_split.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        # the literal bound lets the optimizer put a group limit before the shuffle
        cond = (F.col("__rn") <= max(k_by_split.values())) & \
               (F.col("__rn") <= F.coalesce(kmap[F.col(split_col)], F.lit(0)))
    return ranked.where(cond).drop("__rn")


def debug_subset(df: DataFrame, device: str = "cpu", split_col: str = "split",
                 ord_col: str = "ord") -> DataFrame:
    """90 train / 10 other rows on an accelerator, 16 / 2 otherwise."""
    big = device == "cuda"
    ks = {"train": 90 if big else 16, "valid": 10 if big else 2, "test": 10 if big else 2}
    return first_rows_per_split(df, ks, split_col, ord_col)


def shuffle_into_batches(df: DataFrame, id_col: str, batch_size: int = 64, seed: int = 42,
                         epoch: int = 0, drop_last: bool = True, group_cols: list[str] | None = None,
                         bucket_digits: int = 4) -> DataFrame:
    """Seeded shuffle (md5 of seed, epoch, id), batch number from the rank,
    the last short batch dropped when ``drop_last``."""
    group_cols = group_cols or []
    keyed = df.withColumn("__key", seeded_key(seed, id_col, epoch))
    parts = group_cols if group_cols else ["__g"]
    if not group_cols:
        keyed = keyed.withColumn("__g", F.lit(0))
    ranked = two_phase_row_number(keyed, parts, "__key", hex_bucket("__key", bucket_digits),
                                  out="__rn", tie_cols=[id_col], total="__n")
    out = ranked.withColumn("batch", F.floor((F.col("__rn") - 1) / F.lit(batch_size)).cast("long")) \
                .withColumn("pos_in_batch", ((F.col("__rn") - 1) % F.lit(batch_size)).cast("int"))
    if drop_last:  # the group size comes with the rank: no extra pass, no join
        out = out.where(F.col("__rn") <= F.floor(F.col("__n") / F.lit(batch_size)) * F.lit(batch_size))
    out = out.drop("__n")
    drop = ["__key", "__rn"] + ([] if group_cols else ["__g"])
    return out.drop(*drop)


def epoch_steps(df: DataFrame, id_col: str, epochs: int, batch_size: int = 64, seed: int = 42,
                bucket_digits: int = 4) -> DataFrame:
    """W7 over W6: the batches of ``epochs`` seeded shuffles, last short batches dropped, with the
    running batch number over the epochs.  One ranking by epoch gives the batches and, with the
    same small table, the number of rows; one row per batch comes back."""
    each = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = each.withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(id_col).cast("string"))))
    ranked = two_phase_row_number(keyed, ["epoch"], "__key", hex_bucket("__key", bucket_digits), out="__rn", tie_cols=[id_col], total="__n")
    per_epoch = F.floor(F.col("__n") / batch_size)
    first = ranked.where(((F.col("__rn") - 1) % batch_size == 0) & (F.col("__rn") <= per_epoch * batch_size))
    batch = F.floor((F.col("__rn") - 1) / batch_size).cast("long")
    return first.select("epoch", batch.alias("batch"), global_step(F.col("epoch"), batch, per_epoch).alias("global_step"))


def global_step(epoch: Column, batch: Column, batches_per_epoch: Column) -> Column:
    """Running batch number across epochs (1-based)."""
    return (epoch * batches_per_epoch + batch + F.lit(1)).cast("long")
