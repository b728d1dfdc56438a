"""Registered queries of the preparation block: text, labels, splits, profiles.

Each entry maps a stable ID to ``(spark_fn(spark, sf_dir) -> DataFrame, oracle_sql)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timefmt import stable
from ..operators import profile as PR
from ..operators import splits as SP
from . import sqlparts as S
from .fixtures import SQL_SPLIT, labelled_quality, labelled_text, with_views


def _noisy(col):
    c = F.col(col)
    inner = F.replace(F.replace(F.replace(c, F.lit(". "), F.lit(S.NOISY_SENTENCE)),
                                F.lit(", "), F.lit(S.NOISY_COMMA)),
                      F.lit("\n"), F.lit(S.NOISY_LINE))
    return F.concat(F.lit(S.NOISY_PREFIX), inner, F.lit(S.NOISY_SUFFIX))


def _text_query(fn_spark, fn_sql):
    def q(spark, sf):
        lt = labelled_text(spark, sf)
        return lt.select("ord", fn_spark(_noisy("src")).alias("out"))
    sql = with_views(f"SELECT ord, {fn_sql(S.noisy('src'))} AS out FROM labelled_text", "labelled_text")
    return q, sql


def shrunk_text(spark, sf, keep_formatting=False):
    """labelled_text with X6 applied to ``src``."""
    lt = labelled_text(spark, sf)
    return lt.withColumn("src", X.shrink_text(_noisy("src"), keep_formatting))


SQL_SHRUNK = ("shrunk AS (SELECT ord, " + S.shrink_text(S.noisy("src")) +
              " AS src, label, split FROM labelled_text)")


def flagship(spark, sf):
    """documents + labels -> X6 -> label = quality -> W5 (seed 42) -> A1."""
    lq = labelled_quality(spark, sf).withColumn("src", X.shrink_text("src"))
    split = SP.three_way_split(lq, "label", "ord", 0.8, 0.1, 0.1, seed=42)
    return PR.class_distribution(split)


FLAGSHIP_SQL = with_views(
    "SELECT label, train, valid, test FROM (\n"
    "SELECT CAST(label AS VARCHAR) AS label, CAST(max(CASE WHEN split='train' THEN n END) AS BIGINT) AS train,\n"
    "  CAST(max(CASE WHEN split='valid' THEN n END) AS BIGINT) AS valid,\n"
    "  CAST(max(CASE WHEN split='test' THEN n END) AS BIGINT) AS test\n"
    "FROM (SELECT label, split, count(*) AS n FROM w5 GROUP BY 1, 2) GROUP BY 1\n"
    "UNION ALL\n"
    "SELECT 'Total', CAST(coalesce(sum(CASE WHEN split='train' THEN 1 END), 0) AS BIGINT),\n"
    "  CAST(coalesce(sum(CASE WHEN split='valid' THEN 1 END), 0) AS BIGINT),\n"
    "  CAST(coalesce(sum(CASE WHEN split='test' THEN 1 END), 0) AS BIGINT) FROM w5)",
    "labelled_quality",
    ctes=[f"lq AS (SELECT ord, {S.shrink_text('src')} AS src, label FROM labelled_quality)",
          *S.three_way_ctes("w5", "lq", "label", "ord")])


def _q_w2(spark, sf):
    lq = labelled_quality(spark, sf)
    return SP.stratified_split(lq, "label", "ord", 0.1, seed=42).select("ord", "label", "split")


SQL_W2 = with_views("SELECT ord, label, split FROM w2", "labelled_quality",
                    ctes=S.stratified_ctes("w2", "labelled_quality", "label", "ord", 0.1))


def _q_w5(spark, sf):
    lt = labelled_text(spark, sf).drop("split")
    return SP.three_way_split(lt, "label", "ord", 0.8, 0.1, 0.1, seed=7).select("ord", "label", "split")


SQL_W5 = with_views("SELECT ord, label, split FROM w5", "labelled_text",
                    ctes=["lt AS (SELECT ord, src, label FROM labelled_text)",
                          *S.three_way_ctes("w5", "lt", "label", "ord", seed=7)])


def _q_w3(spark, sf):
    lt = labelled_text(spark, sf)
    return SP.positional_clusters(lt).select("ord", "cluster", "part")


SQL_W3 = with_views(
    "SELECT ord, CAST(floor(ord / (n // 5 + 1)) AS INTEGER) AS cluster,\n"
    "  CASE WHEN floor(ord / (n // 5 + 1)) <= 2 THEN 'pool' ELSE 'test' END AS part\n"
    "FROM labelled_text, (SELECT count(*) AS n FROM labelled_text)", "labelled_text")


def _bifi(spark, sf):
    """W3 then W2 on the pool (ratio_train 0.9) then J2 by id: the pool rows."""
    lt = labelled_text(spark, sf).drop("split").withColumn(
        "ex_id", F.concat(F.lit("id"), F.col("ord").cast("string")))
    out = SP.cluster_split(lt, "label", "ex_id", ratio_train=0.9, seed=42)
    return out.where(F.col("split") != "test").select("ex_id", "ord", "label", "split")


SQL_J2 = with_views("SELECT ex_id, ord, label, CASE WHEN tid IS NOT NULL THEN 'train' ELSE 'valid' END AS split\n"
                    "FROM pool LEFT JOIN (SELECT DISTINCT ex_id AS tid FROM w2 WHERE split = 'train') ON ex_id = tid",
                    "labelled_text",
                    ctes=["pool AS (SELECT 'id' || CAST(ord AS VARCHAR) AS ex_id, ord, src, label FROM labelled_text, "
                          "(SELECT count(*) AS n FROM labelled_text) WHERE floor(ord / (n // 5 + 1)) <= 2)",
                          *S.stratified_ctes("w2", "pool", "label", "ex_id", 1.0 - 0.9)])


def _index_lists(spark, sf):
    """Index lists made from `labels`: train = quality 1, test = toxic 1 (a
    position may be in both lists, or in none)."""
    from ..session import table
    lab = table(spark, sf, "labels")
    tr = lab.where(F.col("quality") == 1).select(F.col("doc_id").alias("ord"), F.lit("train").alias("split"))
    te = lab.where(F.col("toxic") == 1).select(F.col("doc_id").alias("ord"), F.lit("test").alias("split"))
    return tr.unionByName(te)


def _q_j1(spark, sf):
    lt = labelled_text(spark, sf).drop("split")
    out = SP.split_by_index(lt, _index_lists(spark, sf))
    return out.select("split", "ord", X.split_join("src").alias("src"), "label")


SQL_J1 = with_views(
    "SELECT i.split, t.ord, " + S.split_join("t.src") + " AS src, t.label FROM labelled_text t JOIN (\n"
    "SELECT DISTINCT doc_id AS ord, 'train' AS split FROM labels WHERE quality = 1\n"
    "UNION SELECT DISTINCT doc_id, 'test' FROM labels WHERE toxic = 1) i ON t.ord = i.ord", "labelled_text")


def _q_t1(spark, sf):
    return SP.debug_subset(labelled_text(spark, sf), "cpu").select("split", "ord", "label")


SQL_T1 = with_views(
    "SELECT split, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord) AS rn "
    "FROM labelled_text) WHERE rn <= CASE split WHEN 'train' THEN 16 ELSE 2 END", "labelled_text")


def _q_w6(spark, sf):
    lt = labelled_text(spark, sf).where(F.col("split") == "train")
    return SP.shuffle_into_batches(lt, "ord", 64, seed=42, epoch=0, drop_last=True).select(
        "ord", "batch", "pos_in_batch")


SQL_W6 = with_views(
    "SELECT ord, CAST(floor((rn - 1) / 64) AS BIGINT) AS batch, CAST((rn - 1) % 64 AS INTEGER) AS pos_in_batch\n"
    "FROM (SELECT ord, row_number() OVER (ORDER BY " + S.seeded_key(42, "ord", 0) + ", ord) AS rn,\n"
    "             count(*) OVER () AS n FROM labelled_text WHERE split = 'train')\n"
    "WHERE rn <= (n // 64) * 64", "labelled_text")


def _q_w7(spark, sf):
    lt = labelled_text(spark, sf).where(F.col("split") == "train")
    return SP.epoch_steps(lt, "ord", epochs=3, batch_size=64, seed=42)


SQL_W7 = with_views(
    "SELECT CAST(e.epoch AS INTEGER) AS epoch, b.batch, CAST(e.epoch * nb + b.batch + 1 AS BIGINT) AS global_step\n"
    "FROM (SELECT range AS epoch FROM range(3)) e,\n"
    "     (SELECT CAST(count(*) // 64 AS BIGINT) AS nb FROM labelled_text WHERE split = 'train') n,\n"
    "     (SELECT CAST(unnest(range(count(*) // 64)) AS BIGINT) AS batch FROM labelled_text WHERE split = 'train') b", "labelled_text")


# -- profiles ---------------------------------------------------------------

def _tok(spark, sf):
    return PR.with_token_count(shrunk_text(spark, sf))


SQL_TOK = ("tok AS (SELECT ord, src, label, split, " + S.token_count("src") + " AS n_tokens FROM shrunk)")


def _a1(spark, sf):
    return PR.class_distribution(labelled_text(spark, sf))


SQL_A1 = with_views(
    "SELECT label, CAST(max(CASE WHEN split='train' THEN n END) AS BIGINT) AS train,\n"
    "  CAST(max(CASE WHEN split='valid' THEN n END) AS BIGINT) AS valid,\n"
    "  CAST(max(CASE WHEN split='test' THEN n END) AS BIGINT) AS test\n"
    "FROM (SELECT CAST(label AS VARCHAR) AS label, split, count(*) AS n FROM labelled_text GROUP BY 1, 2) GROUP BY 1\n"
    "UNION ALL SELECT 'Total', CAST(sum(CASE WHEN split='train' THEN 1 ELSE 0 END) AS BIGINT),\n"
    "  CAST(sum(CASE WHEN split='valid' THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN split='test' THEN 1 ELSE 0 END) AS BIGINT)\n"
    "FROM labelled_text", "labelled_text")


def _a2(spark, sf):
    return PR.label_counts(labelled_text(spark, sf), "train")


SQL_A2 = with_views("SELECT label, count(*) AS n FROM labelled_text WHERE split = 'train' GROUP BY label",
                    "labelled_text")


def _a3(spark, sf):
    return PR.class_weights(labelled_text(spark, sf).where(F.col("split") == "train")) \
        .withColumn("weight", F.round(stable("weight"), 6))


SQL_A3 = with_views(
    "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code, n,\n"
    "  " + S.sround("n / sum(n) OVER ()", 6) + " AS weight\n"
    "FROM (SELECT label, count(*) AS n FROM labelled_text WHERE split = 'train' GROUP BY label)", "labelled_text")


def _with_shrunk_tok(sql_body):
    return with_views(sql_body, "labelled_text", ctes=[SQL_SHRUNK, SQL_TOK])


_DESC_SQL = ("CAST(count(n_tokens) AS BIGINT) AS count, round_even(avg(n_tokens), 0) AS mean, "
             "round_even(stddev_samp(n_tokens), 0) AS std, round_even(CAST(min(n_tokens) AS DOUBLE), 0) AS min, "
             "round_even(quantile_cont(n_tokens, 0.25), 0) AS p25, round_even(quantile_cont(n_tokens, 0.5), 0) AS p50, "
             "round_even(quantile_cont(n_tokens, 0.75), 0) AS p75, round_even(CAST(max(n_tokens) AS DOUBLE), 0) AS max")


def _a4(spark, sf):
    return PR.describe_tokens(_tok(spark, sf))


SQL_A4 = _with_shrunk_tok(f"SELECT split, {_DESC_SQL} FROM tok GROUP BY split")


def _a5(spark, sf):
    return PR.describe_tokens_by_class(_tok(spark, sf))


SQL_A5 = _with_shrunk_tok(f"SELECT split, label, {_DESC_SQL} FROM tok GROUP BY split, label")


def _a6(spark, sf):
    out = PR.dataset_stats(_tok(spark, sf))
    return out.select("split", "num_samples", F.round(stable("num_tokens_avg"), 6).alias("num_tokens_avg"),
                      "num_tokens_max", "num_tokens_min", F.round(stable("num_tokens_std"), 6).alias("num_tokens_std"))


SQL_A6 = _with_shrunk_tok(
    "SELECT split, count(*) AS num_samples, " + S.sround("avg(n_tokens)", 6) + " AS num_tokens_avg, "
    "max(n_tokens) AS num_tokens_max,\n"
    "  min(n_tokens) AS num_tokens_min, " + S.sround("stddev_pop(n_tokens)", 6) + " AS num_tokens_std FROM tok GROUP BY split")


def _a7(spark, sf):
    return PR.unique_labels(labelled_text(spark, sf))


SQL_A7 = with_views("SELECT DISTINCT label FROM labelled_text", "labelled_text")


def _a7n(spark, sf):
    return PR.num_classes(labelled_text(spark, sf))


SQL_A7N = with_views("SELECT CAST(count(DISTINCT label) AS BIGINT) AS num_classes FROM labelled_text WHERE split = 'train'",
                     "labelled_text")


def _a8_input(spark, sf):
    """documents labelled by ``source``: sources that miss a split are violations."""
    from ..session import table
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 10
    return d.select(F.col("source").alias("label"),
                    F.when(m < 8, "train").when(m == 8, "valid").otherwise("test").alias("split"))


def _a8(spark, sf):
    return PR.label_set_check(_a8_input(spark, sf))


SQL_A8 = ("SELECT label, CAST(count(DISTINCT split) AS INTEGER) AS n_splits,\n"
          "  array_to_string(list_sort(list_filter(['test', 'train', 'valid'], lambda s: NOT list_contains(list(DISTINCT split), s))), ',') AS missing\n"
          "FROM (SELECT source AS label, " + SQL_SPLIT + " AS split FROM documents) GROUP BY label HAVING count(DISTINCT split) < 3")


def _j3(spark, sf):
    return PR.split_overlap(shrunk_text(spark, sf))


SQL_J3 = with_views(
    "SELECT o.split, CAST(count(DISTINCT t.src) AS BIGINT) AS overlap FROM\n"
    "(SELECT 'valid' AS split UNION ALL SELECT 'test') o\n"
    "LEFT JOIN (SELECT DISTINCT src, split FROM shrunk) x ON x.split = o.split\n"
    "LEFT JOIN (SELECT DISTINCT src FROM shrunk WHERE split = 'train') t ON t.src = x.src\n"
    "GROUP BY o.split", "labelled_text", ctes=[SQL_SHRUNK])


def _t2(spark, sf):
    return PR.first_examples(shrunk_text(spark, sf), 3)


SQL_T2 = with_views(
    "SELECT split, ord, src, " + S.tokens_joined("src") + " AS tokens, " + S.token_count("src") + " AS n_tokens\n"
    "FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord) AS rn FROM shrunk) WHERE rn <= 3",
    "labelled_text", ctes=[SQL_SHRUNK])


def _o3(spark, sf):
    return PR.intersect_texts(shrunk_text(spark, sf), "train", "test")


SQL_O3 = with_views("SELECT src FROM shrunk WHERE split = 'train' INTERSECT SELECT src FROM shrunk WHERE split = 'test'",
                    "labelled_text", ctes=[SQL_SHRUNK])


def _o4(spark, sf):
    return PR.union_labels(labelled_text(spark, sf))


SQL_O4 = with_views("SELECT label FROM labelled_text WHERE split = 'train' UNION SELECT label FROM labelled_text "
                    "WHERE split = 'valid' UNION SELECT label FROM labelled_text WHERE split = 'test'", "labelled_text")


def _o2(spark, sf):
    """Union of the two labelled sources (documents by language, documents by quality)."""
    a = labelled_text(spark, sf).select("ord", F.col("label").cast("string").alias("label"),
                                        F.lit("lang").alias("source"))
    b = labelled_quality(spark, sf).select("ord", F.col("label").cast("string").alias("label"),
                                           F.lit("quality").alias("source"))
    return a.unionByName(b)


SQL_O2 = with_views("SELECT ord, CAST(label AS VARCHAR) AS label, 'lang' AS source FROM labelled_text UNION ALL "
                    "SELECT ord, CAST(label AS VARCHAR), 'quality' FROM labelled_quality",
                    "labelled_text", "labelled_quality")


def _o5(spark, sf):
    """Split names of the data minus the expected three."""
    lt = labelled_text(spark, sf).select("split")
    expected = lt.sparkSession.createDataFrame([("train",), ("valid",)], "split string")
    return lt.distinct().subtract(expected)


SQL_O5 = with_views("SELECT DISTINCT split FROM labelled_text EXCEPT SELECT * FROM (VALUES ('train'), ('valid')) v(split)",
                    "labelled_text")


def _j7(spark, sf):
    d = PR.describe_tokens(_tok(spark, sf))
    long = d.select("split", F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value"))
        for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")])).alias("r")) \
        .select("split", "r.stat", "r.value")
    return PR.align_columns(long, ["stat"], "split", ["train", "valid", "test"], "value")


SQL_J7 = _with_shrunk_tok(
    "SELECT stat, max(CASE WHEN split='train' THEN value END) AS train, max(CASE WHEN split='valid' THEN value END) AS valid,\n"
    "  max(CASE WHEN split='test' THEN value END) AS test FROM (\n"
    "  SELECT split, unnest(['count','mean','std','min','p25','p50','p75','max']) AS stat,\n"
    "         unnest([CAST(count AS DOUBLE), mean, std, min, p25, p50, p75, max]) AS value FROM (\n"
    f"  SELECT split, {_DESC_SQL} FROM tok GROUP BY split)) GROUP BY stat")


QUERIES = {}


def _reg(name, fn, sql):
    QUERIES[name] = (fn, sql)


for _name, _fs, _fq in [
    ("X1_py_strip", X.py_strip, S.strip),
    ("X2_collapse_newlines", X.collapse_newlines, S.collapse_newlines),
    ("X3_spaces_to_tab", X.spaces_to_tab, S.spaces_to_tab),
    ("X4_separators_to_space", X.separators_to_space, S.separators_to_space),
    ("X5_collapse_spaces", X.collapse_spaces, S.collapse_spaces),
    ("X6_shrink_text", X.shrink_text, S.shrink_text),
    ("X6_shrink_text_keep_formatting", lambda c: X.shrink_text(c, True), lambda e: S.shrink_text(e, True)),
    ("X7_split_join", X.split_join, S.split_join),
    ("X9_token_count", X.token_count, S.token_count),
]:
    _reg(_name, *_text_query(_fs, _fq))

_reg("W2_stratified_split", _q_w2, SQL_W2)
_reg("W3_positional_cluster_split", _q_w3, SQL_W3)
_reg("W5_three_way_split", _q_w5, SQL_W5)
_reg("W6_shuffle_into_batches", _q_w6, SQL_W6)
_reg("W7_global_step", _q_w7, SQL_W7)
_reg("J1_split_by_index", _q_j1, SQL_J1)
_reg("J2_split_by_id", _bifi, SQL_J2)
_reg("T1_debug_subset", _q_t1, SQL_T1)
_reg("A1_class_distribution", _a1, SQL_A1)
_reg("A2_label_counts", _a2, SQL_A2)
_reg("A3_class_weights", _a3, SQL_A3)
_reg("A4_describe_tokens", _a4, SQL_A4)
_reg("A5_describe_tokens_by_class", _a5, SQL_A5)
_reg("A6_dataset_stats", _a6, SQL_A6)
_reg("A7_unique_labels", _a7, SQL_A7)
_reg("A7_num_classes", _a7n, SQL_A7N)
_reg("A8_label_set_check", _a8, SQL_A8)
_reg("J3_split_overlap", _j3, SQL_J3)
_reg("J7_align_columns", _j7, SQL_J7)
_reg("T2_first_examples", _t2, SQL_T2)
_reg("O2_union_all", _o2, SQL_O2)
_reg("O3_intersect_distinct", _o3, SQL_O3)
_reg("O4_union_distinct", _o4, SQL_O4)
_reg("O5_difference", _o5, SQL_O5)
_reg("entry_flagship", flagship, FLAGSHIP_SQL)


def _a4_label(spark, sf):
    """A4 when labels are integers: token count and label described per split."""
    lq = labelled_quality(spark, sf).withColumn("src", X.shrink_text("src"))
    split = SP.three_way_split(lq, "label", "ord", 0.8, 0.1, 0.1, seed=42)
    return PR.describe_columns(PR.with_token_count(split), ["n_tokens", "label"])


_DESC_V = _DESC_SQL.replace("n_tokens", "v")
QUERIES["A4_describe_tokens_and_label"] = (_a4_label, with_views(
    f"SELECT split, \"column\", {_DESC_V} FROM (SELECT split, 'n_tokens' AS \"column\", CAST(n_tokens AS DOUBLE) AS v FROM tokq "
    "UNION ALL SELECT split, 'label', CAST(label AS DOUBLE) FROM tokq) GROUP BY split, \"column\"",
    "labelled_quality",
    ctes=[f"lq AS (SELECT ord, {S.shrink_text('src')} AS src, label FROM labelled_quality)",
          *S.three_way_ctes("w5", "lq", "label", "ord"),
          f"tokq AS (SELECT split, label, {S.token_count('src')} AS n_tokens FROM w5)"]))


def _a5_wide(spark, sf):
    return PR.describe_tokens_by_class_wide(_tok(spark, sf))


_WIDE_SQL = ", ".join(f"max(CASE WHEN split = '{sp}' THEN {st} END) AS {sp}_{st}"
                      for sp in ("train", "valid", "test") for st in PR.STATS)
QUERIES["A5_describe_tokens_by_class_wide"] = (_a5_wide, _with_shrunk_tok(
    f"SELECT label, {_WIDE_SQL} FROM (SELECT split, label, {_DESC_SQL} FROM tok GROUP BY split, label) GROUP BY label"))
