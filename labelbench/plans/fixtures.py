"""Derived views over the provided tables (FIXTURES.md part C).

Each view exists twice: as a DataFrame built from the parquet tables, and as
the SQL text of a common-table expression that the DuckDB oracle runs on the
same tables.  Both must define the same rows; every registered query starts
from one of them, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import hms, stable
from ..session import table

# Event types of the `events` table mapped to five pooling
# combination names for the derived run table.
EVENT_COMBINATION = {
    "click": "cutoff_layers_one_layer_cls",
    "view": "one_layer_cls",
    "purchase": "one_layer_w_sum_tokens",
    "signup": "max_pool_layers_max_pool_tokens",
    "error": "w_sum_cls",
}


def _split_of(col: str):
    m = F.col(col) % 10
    return F.when(m < 8, "train").when(m == 8, "valid").otherwise("test")


def labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    """documents as labelled examples: src=text, label=lang, ord=doc_id."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("text").alias("src"),
                    F.col("lang").alias("label"), _split_of("doc_id").alias("split"))


def labelled_quality(spark: SparkSession, sf: str) -> DataFrame:
    """documents joined with labels: label = quality (binary)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("ord"), F.col("text").alias("src"),
                                        F.col("quality").alias("label"))


def ten_logits(col: str):
    """Logit c = sum of the values at positions c, c + 10, c + 20, ..., added in that order."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.sequence(c, F.size(v) - 1, F.lit(10)), F.lit(0.0), lambda s, i: s + F.get(v, i)))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two prediction tables in one: ``quality`` (y_true=quality, y_pred=toxic)
    and ``embed`` (y_true=label, y_pred=argmax of the ten logits)."""
    lab = table(spark, sf, "labels").select(
        F.lit("quality").alias("task"), F.col("doc_id").alias("ex_id"),
        F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    ten = ten_logits("embedding")
    emb = table(spark, sf, "embeddings").select(
        F.lit("embed").alias("task"), F.col("vec_id").alias("ex_id"),
        F.col("label").alias("y_true"),
        (F.array_position(ten, F.array_max(ten)) - 1).cast("int").alias("y_pred"))
    return lab.unionByName(emb)


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Logits of the ``embed`` task: all values folded into ten, batch of 64."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ex_id"),
                    ten_logits("embedding").alias("logits"),
                    F.col("label").alias("y"),
                    F.floor(F.col("vec_id") / 64).cast("long").alias("batch"))


def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """events as a validation log: run=user_id%10, epoch=day of month,
    value=round(avg(value), 6), step = running event count of the run."""
    e = table(spark, sf, "events")
    g = (e.groupBy((F.col("user_id") % 10).cast("int").alias("run_id"),
                   F.dayofmonth("ts").cast("int").alias("epoch"))
         .agg(F.round(stable(F.avg("value")), 6).alias("value"), F.count(F.lit(1)).alias("n")))
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("run_id", F.lit("valid").alias("mode"), "epoch",
                    F.sum("n").over(w).cast("long").alias("step"),
                    F.lit("acc_valid").alias("metric"), "value")


def _ts_text(c):
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as an experiment-run table."""
    e = table(spark, sf, "events")
    comb = F.create_map(*[F.lit(x) for kv in EVENT_COMBINATION.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    layer = ((F.col("user_id") % 12) + 1).cast("int")
    end = F.expr("timestampadd(MICROSECOND, CAST(round(value * 60000000) AS BIGINT), ts)")
    return e.select(
        F.concat(F.lit("d"), (F.floor((F.col("event_id") % 40) / 10)).cast("string")).alias("dataset"),
        F.col("event_id").alias("ord"),
        comb.alias("combination_type"),
        layer.alias("hidden_layer_to_use"),
        (F.col("event_id") % 10).cast("int").alias("seed"),
        F.when(F.col("event_id") % 97 == 0, 5).otherwise(10).cast("int").alias("epochs"),
        (~comb.contains("cls") & ((F.floor(F.col("user_id") / 12) % 2) == 1)).alias(
            "not_special_tokens_to_zero"),
        (layer.cast("long") * 7087872 + 1538).alias("num_trainable_parameters"),
        _ts_text(F.col("ts")).alias("start_time"),
        _ts_text(end).alias("end_time"),
        (value / 10).alias("time_train_min"),
        hms(F.round(value * 60).cast("long")).alias("total_time"),
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("double"))
         .otherwise(value / 100).alias("acc_test"),
        (k / 100).alias("balanced_acc_test"),
        (value / 100).alias("f1_micro_test"),
        ((value + k) / 200).alias("f1_macro_test"),
        ((value * 3 + k) / 400).alias("f1_weighted_test"),
    )


def hidden_states(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as per-layer, per-token states (D12): example = vec_id div 60,
    layer = (vec_id div 5) % 12 + 1, pos = vec_id % 5, mask 0 at pos 4 of odd examples."""
    e = table(spark, sf, "embeddings")
    ex = F.floor(F.col("vec_id") / 60).cast("long")
    pos = (F.col("vec_id") % 5).cast("int")
    return e.select(
        ex.alias("example_id"),
        ((F.floor(F.col("vec_id") / 5) % 12) + 1).cast("int").alias("layer"),
        pos.alias("pos"),
        F.when((pos == 4) & (ex % 2 == 1), 0).otherwise(1).cast("int").alias("mask"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


# ---------------------------------------------------------------------------
# The same views as DuckDB common-table expressions.
# ---------------------------------------------------------------------------

SQL_SPLIT = ("CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' "
             "ELSE 'test' END")

SQL_VIEWS = {
    "labelled_text": f"""labelled_text AS (
  SELECT doc_id AS ord, text AS src, lang AS label, {SQL_SPLIT} AS split FROM documents)""",
    "labelled_quality": """labelled_quality AS (
  SELECT d.doc_id AS ord, d.text AS src, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "predictions": """predictions AS (
  SELECT 'quality' AS task, doc_id AS ex_id, quality AS y_true, toxic AS y_pred FROM labels
  UNION ALL
  SELECT 'embed' AS task, vec_id AS ex_id, label AS y_true,
         CAST(list_position(ten, list_max(ten)) - 1 AS INTEGER) AS y_pred
  FROM (SELECT *, list_transform(range(10), lambda c: list_reduce([CAST(0.0 AS DOUBLE)] || list_transform(range(c, len(embedding), 10), lambda i: CAST(embedding[i + 1] AS DOUBLE)), lambda a, b: a + b)) AS ten FROM embeddings))""",
    "logits": """logits AS (
  SELECT vec_id AS ex_id, list_transform(range(10), lambda c: list_reduce([CAST(0.0 AS DOUBLE)] || list_transform(range(c, len(embedding), 10), lambda i: CAST(embedding[i + 1] AS DOUBLE)), lambda a, b: a + b)) AS logits,
         label AS y, CAST(floor(vec_id / 64) AS BIGINT) AS batch FROM embeddings)""",
    "epoch_metrics": """epoch_metrics AS (
  SELECT run_id, 'valid' AS mode, epoch,
         CAST(sum(n) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS step,
         'acc_valid' AS metric, value
  FROM (SELECT CAST(user_id % 10 AS INTEGER) AS run_id, CAST(day(ts) AS INTEGER) AS epoch,
               CAST(round(CAST(CAST(round(avg(value), 9) AS VARCHAR) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS value,
               count(*) AS n
        FROM events GROUP BY 1, 2))""",
    "runs": """runs AS (
  SELECT 'd' || CAST(CAST(floor((event_id % 40) / 10) AS BIGINT) AS VARCHAR) AS dataset,
         event_id AS ord, comb AS combination_type, layer AS hidden_layer_to_use,
         CAST(event_id % 10 AS INTEGER) AS seed,
         CAST(CASE WHEN event_id % 97 = 0 THEN 5 ELSE 10 END AS INTEGER) AS epochs,
         (NOT contains(comb, 'cls') AND CAST(floor(user_id / 12) AS BIGINT) % 2 = 1) AS not_special_tokens_to_zero,
         CAST(layer AS BIGINT) * 7087872 + 1538 AS num_trainable_parameters,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS start_time,
         strftime(ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS end_time,
         value / 10 AS time_train_min,
         CASE WHEN secs // 86400 = 1 THEN '1 day, ' WHEN secs // 86400 > 1 THEN CAST(secs // 86400 AS VARCHAR) || ' days, '
              ELSE '' END || printf('%d:%02d:%02d', (secs % 86400) // 3600, (secs % 3600) // 60, secs % 60) AS total_time,
         CASE WHEN event_id % 89 = 0 THEN NULL ELSE value / 100 END AS acc_test,
         k / 100 AS balanced_acc_test,
         value / 100 AS f1_micro_test,
         (value + k) / 200 AS f1_macro_test,
         (value * 3 + k) / 400 AS f1_weighted_test
  FROM (SELECT *, CAST(user_id % 12 + 1 AS INTEGER) AS layer, CAST(round(value * 60) AS BIGINT) AS secs,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CASE event_type WHEN 'click' THEN 'cutoff_layers_one_layer_cls'
                               WHEN 'view' THEN 'one_layer_cls'
                               WHEN 'purchase' THEN 'one_layer_w_sum_tokens'
                               WHEN 'signup' THEN 'max_pool_layers_max_pool_tokens'
                               WHEN 'error' THEN 'w_sum_cls' END AS comb
        FROM events))""",
    "hidden_states": """hidden_states AS (
  SELECT CAST(floor(vec_id / 60) AS BIGINT) AS example_id,
         CAST(CAST(floor(vec_id / 5) AS BIGINT) % 12 + 1 AS INTEGER) AS layer,
         CAST(vec_id % 5 AS INTEGER) AS pos,
         CAST(CASE WHEN vec_id % 5 = 4 AND CAST(floor(vec_id / 60) AS BIGINT) % 2 = 1 THEN 0 ELSE 1 END AS INTEGER) AS mask,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM embeddings)""",
}


def with_views(sql: str, *views: str, ctes=(), recursive: bool = False) -> str:
    """Prefix ``sql`` with the view CTEs it needs, then extra ``ctes`` (in order)."""
    parts = [SQL_VIEWS[v] for v in views] + list(ctes)
    if not parts:
        return sql
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + sql
