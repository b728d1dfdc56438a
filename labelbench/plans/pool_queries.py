"""Registered queries: vector pooling and heads (V1-V19) and label encoding
(P1-P4, X8, X10, X11, X19) on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import argmax, layer_norm, vsum
from ..operators import labels as L
from ..operators import pooling as PO
from ..operators import scoring as SC
from ..session import cut_lineage, table
from . import sqlparts as S
from .fixtures import hidden_states, labelled_text, with_views

QUERIES = {}

# Weights of the weighted sums: learned parameters in the original, fixed by a
# rule here (some negative, so the sign handling is exercised).
W_TOKENS = [((p % 7) - 3) / 4 for p in range(512)]
W_LAYERS = [(i - 5.5) / 4 for i in range(12)]
N_CLASSES = 10
HIDDEN = 64
W_LIN = [[(((c * 7 + h * 3) % 11) - 5) / 10 for h in range(HIDDEN)] for c in range(N_CLASSES)]
B_LIN = [c / 10 for c in range(N_CLASSES)]
W1 = [[(((j * 5 + h * 11) % 13) - 6) / 20 for h in range(HIDDEN)] for j in range(HIDDEN)]
B1 = [((j % 5) - 2) / 10 for j in range(HIDDEN)]
W2 = [[(((c * 3 + j * 7) % 9) - 4) / 10 for j in range(HIDDEN)] for c in range(N_CLASSES)]
B2 = [0.1 * c - 0.5 for c in range(N_CLASSES)]


def _lst(v):
    return "[" + ", ".join(repr(float(x)) for x in v) + "]"


SQL_WT = _lst(W_TOKENS)
SQL_WL = _lst(W_LAYERS)

SQL_MASK_REF = [
    "tok AS (SELECT DISTINCT example_id, pos, mask FROM hidden_states)",
    "mst AS (SELECT example_id, sum(mask) AS n_real, max(pos) + 1 AS n_pos, "
    "coalesce(max(CASE WHEN pos = 0 THEN mask END), 0) AS m0 FROM tok GROUP BY example_id)",
    "sec AS (SELECT example_id, CASE WHEN n_real - m0 - 1 < 0 THEN n_pos + n_real - m0 - 1 ELSE n_real - m0 - 1 END AS second FROM mst)",
    "hsm AS (SELECT h.*, CASE WHEN h.pos = 0 OR h.pos = s.second THEN 0 ELSE h.mask END AS eff FROM hidden_states h JOIN sec s USING (example_id))",
]
SQL_MASK_PLAIN = ["hsm AS (SELECT *, mask AS eff FROM hidden_states)"]
SQL_HSX = ("hsx AS (SELECT example_id, layer, pos, eff, CASE WHEN eff = 0 THEN 0.0 ELSE x END AS x, dim FROM "
           "(SELECT example_id, layer, pos, eff, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM hsm))")


def _pool_q(spark_fn, agg_sql, special=False):
    def q(spark, sf):
        return PO.explode_vectors(spark_fn(hidden_states(spark, sf)))
    ctes = [*(SQL_MASK_REF if special else SQL_MASK_PLAIN), SQL_HSX]
    sql = with_views(f"SELECT example_id, CAST(dim AS INTEGER) AS dim, round(value, 9) AS value FROM ({agg_sql})",
                     "hidden_states", ctes=ctes)
    return q, sql


def _reg(name, q):
    QUERIES[name] = q


def _v1(spark, sf):
    m = PO.mask_states(hidden_states(spark, sf), special_tokens_to_zero=True)
    return m.select(PO.KEY, "layer", "pos", "eff_mask",
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)), 9).alias("l1"))


_reg("V1_mask_states", (_v1, with_views(
    "SELECT example_id, layer, pos, eff AS eff_mask, round(sum(abs(x)), 9) AS l1 FROM hsx GROUP BY ALL",
    "hidden_states", ctes=[*SQL_MASK_REF, SQL_HSX])))


def _v2(spark, sf):
    hs = hidden_states(spark, sf).withColumn("vec", layer_norm("vec"))
    return hs.select(PO.KEY, "layer", "pos", F.posexplode("vec").alias("dim", "value")) \
             .withColumn("value", F.round("value", 9))


_reg("V2_layer_norm", (_v2, with_views(
    "SELECT example_id, layer, pos, CAST(dim AS INTEGER) AS dim, round((x - mu) / sqrt(var + 1e-05), 9) AS value FROM "
    "(SELECT example_id, layer, pos, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim, "
    "list_sum(vec) / len(vec) AS mu, list_aggregate(vec, 'var_pop') AS var FROM hidden_states)", "hidden_states")))

_reg("V3_one_layer_cls", _pool_q(lambda hs: PO.one_layer_cls(hs, 7),
                                 "SELECT example_id, dim, x AS value FROM hsx WHERE layer = 7 AND pos = 0"))
_reg("V4_one_layer_w_sum_tokens", _pool_q(
    lambda hs: PO.one_layer_w_sum_tokens(hs, 7, W_TOKENS),
    f"SELECT example_id, dim, sum(x * {SQL_WT}[pos + 1]) AS value FROM hsx WHERE layer = 7 GROUP BY ALL"))
_reg("V5_one_layer_max_pool_tokens", _pool_q(
    lambda hs: PO.one_layer_max_pool_tokens(hs, 7, special_tokens_to_zero=True),
    "SELECT example_id, dim, max(x) AS value FROM hsx WHERE layer = 7 GROUP BY ALL", special=True))
_reg("V6_w_sum_tokens_w_sum_layers", _pool_q(
    lambda hs: PO.w_sum_tokens_w_sum_layers(hs, W_TOKENS, W_LAYERS),
    f"SELECT example_id, dim, sum(x * {SQL_WT}[pos + 1] * {SQL_WL}[layer]) AS value FROM hsx WHERE layer >= 1 GROUP BY ALL"))
_reg("V7_max_pool_layers_w_sum_tokens", _pool_q(
    lambda hs: PO.max_pool_layers_w_sum_tokens(hs, W_TOKENS, special_tokens_to_zero=True),
    f"SELECT example_id, dim, sum(m * {SQL_WT}[pos + 1]) AS value FROM (SELECT example_id, pos, dim, max(x) AS m FROM hsx "
    "WHERE layer >= 1 GROUP BY ALL) GROUP BY example_id, dim", special=True))
_reg("V8_w_sum_layers_w_sum_tokens", _pool_q(
    lambda hs: PO.w_sum_layers_w_sum_tokens(hs, W_TOKENS, W_LAYERS, special_tokens_to_zero=True),
    f"SELECT example_id, dim, sum(x * {SQL_WL}[layer] * {SQL_WT}[pos + 1]) AS value FROM hsx WHERE layer >= 1 GROUP BY ALL",
    special=True))
_reg("V9_max_pool_tokens_w_sum_layers", _pool_q(
    lambda hs: PO.max_pool_tokens_w_sum_layers(hs, W_LAYERS),
    f"SELECT example_id, dim, sum(m * {SQL_WL}[layer]) AS value FROM (SELECT example_id, layer, dim, max(x) AS m FROM hsx "
    "WHERE layer >= 1 GROUP BY ALL) GROUP BY example_id, dim"))
_reg("V10_max_pool_layers_max_pool_tokens", _pool_q(
    lambda hs: PO.max_pool_layers_max_pool_tokens(hs),
    "SELECT example_id, dim, max(x) AS value FROM hsx WHERE layer >= 1 GROUP BY ALL"))
_reg("V11_w_sum_cls", _pool_q(
    lambda hs: PO.w_sum_cls(hs, W_LAYERS),
    f"SELECT example_id, dim, sum(x * {SQL_WL}[layer]) AS value FROM hsx WHERE layer >= 1 AND pos = 0 GROUP BY ALL"))
_reg("V12_max_pool_cls", _pool_q(
    lambda hs: PO.max_pool_cls(hs),
    "SELECT example_id, dim, max(x) AS value FROM hsx WHERE layer >= 1 AND pos = 0 GROUP BY ALL"))
_reg("V13_last_layer_cls", _pool_q(lambda hs: PO.last_layer_cls(hs, 12),
                                   "SELECT example_id, dim, x AS value FROM hsx WHERE layer = 12 AND pos = 0"))
_reg("V14_cutoff_layers_one_layer_cls", _pool_q(
    lambda hs: PO.cutoff_layers_one_layer_cls(hs, 5),
    "SELECT example_id, dim, x AS value FROM hsx WHERE layer <= 5 AND layer = 5 AND pos = 0"))

SQL_POOLED = ("pooled AS (SELECT example_id, list(x ORDER BY dim) AS vec FROM (SELECT example_id, dim, max(x) AS x FROM hsx "
              "WHERE layer >= 1 GROUP BY ALL) GROUP BY example_id)")


def _v17(spark, sf):
    pooled = PO.max_pool_layers_max_pool_tokens(hidden_states(spark, sf))
    out = SC.score_linear(pooled, W_LIN, B_LIN)
    return out.select(PO.KEY, F.posexplode("logits").alias("cls", "logit")).withColumn("logit", F.round("logit", 9))


_W_LIN_SQL = ", ".join(f"({c}, {_lst(W_LIN[c])}, {B_LIN[c]!r})" for c in range(N_CLASSES))
_reg("V17_score_linear", (_v17, with_views(
    "SELECT p.example_id, CAST(w.c AS INTEGER) AS cls, round(list_dot_product(p.vec, w.row) + w.b, 9) AS logit "
    f"FROM pooled p, (VALUES {_W_LIN_SQL}) w(c, row, b)", "hidden_states", ctes=[*SQL_MASK_PLAIN, SQL_HSX, SQL_POOLED])))


def _v18(spark, sf):
    pooled = PO.max_pool_layers_max_pool_tokens(hidden_states(spark, sf))
    out = SC.score_dense_tanh(pooled, W1, B1, W2, B2)
    return out.select(PO.KEY, F.posexplode("logits").alias("cls", "logit")).withColumn("logit", F.round("logit", 9))


_W1_SQL = ", ".join(f"({j}, {_lst(W1[j])}, {B1[j]!r})" for j in range(HIDDEN))
_W2_SQL = ", ".join(f"({c}, {j}, {W2[c][j]!r})" for c in range(N_CLASSES) for j in range(HIDDEN))
_B2_SQL = ", ".join(f"({c}, {B2[c]!r})" for c in range(N_CLASSES))
_reg("V18_score_dense_tanh", (_v18, with_views(
    "SELECT h.example_id, CAST(w2.c AS INTEGER) AS cls, round(sum(w2.w * h.h) + max(b2.b), 9) AS logit FROM "
    f"(SELECT p.example_id, w1.j, tanh(list_dot_product(p.vec, w1.row) + w1.b) AS h FROM pooled p, (VALUES {_W1_SQL}) w1(j, row, b)) h "
    f"JOIN (VALUES {_W2_SQL}) w2(c, j, w) ON h.j = w2.j JOIN (VALUES {_B2_SQL}) b2(c, b) ON b2.c = w2.c GROUP BY h.example_id, w2.c",
    "hidden_states", ctes=[*SQL_MASK_PLAIN, SQL_HSX, SQL_POOLED])))


STEPS, RATE = 3, 0.5


def _labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("example_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        F.col("label").cast("int").alias("label"))


def _v19(spark, sf):
    w, b = SC.fit_head_steps(_labelled_vectors(spark, sf), N_CLASSES, HIDDEN, steps=STEPS, rate=RATE)
    rows = [(c, j, float(v)) for c in range(N_CLASSES) for j, v in enumerate([*w[c], b[c]])]
    return spark.createDataFrame(rows, "cls int, dim int, weight double").withColumn("weight", F.round("weight", 8))


def _v19_ctes():
    """Position 64 is the constant, so its weight is the bias."""
    ctes = ["WITH ex AS (SELECT vec_id, label, CAST(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [1.0]) AS DOUBLE) AS x, "
            "generate_subscripts(embedding || [1.0], 1) - 1 AS dim FROM embeddings)",
            f"w0 AS (SELECT c.range AS cls, d.range AS dim, CAST(0 AS DOUBLE) AS weight FROM range({N_CLASSES}) c, range({HIDDEN + 1}) d)"]
    for k in range(STEPS):
        ctes += [
            f"z{k} AS (SELECT vec_id, label, cls, sum(x * weight) AS z FROM ex JOIN w{k} USING (dim) GROUP BY ALL)",
            f"p{k} AS (SELECT vec_id, cls, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) - CASE WHEN label = cls THEN 1 ELSE 0 END AS r "
            f"FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{k}))",
            f"g{k} AS (SELECT cls, dim, sum(r * x) / (SELECT count(*) FROM embeddings) AS g FROM p{k} JOIN ex USING (vec_id) GROUP BY ALL)",
            f"w{k + 1} AS (SELECT cls, dim, weight - {RATE!r} * g AS weight FROM w{k} JOIN g{k} USING (cls, dim))"]
    return ",\n".join(ctes)


_reg("V19_fit_head", (_v19, _v19_ctes() + f"\nSELECT CAST(cls AS INTEGER) AS cls, CAST(dim AS INTEGER) AS dim, round(weight, 8) AS weight FROM w{STEPS}"))


def _v19_predictions(spark, sf):
    """The class of the largest logit (rounded, so that the order of a sum decides nothing; the first of equals)."""
    emb = _labelled_vectors(spark, sf)
    w, b = SC.fit_head_steps(emb, N_CLASSES, HIDDEN, steps=STEPS, rate=RATE)
    scored = emb.withColumn("logits", F.transform(SC.linear("vec", w, b), lambda z: F.round(z, 8)))
    return scored.select("example_id", F.col("label").alias("y_true"), argmax("logits").cast("int").alias("y_pred"))


_reg("V19_fit_head_predictions", (_v19_predictions, _v19_ctes() + f""",
scored AS (SELECT vec_id, label, cls, round(sum(x * weight), 8) AS z FROM ex JOIN w{STEPS} USING (dim) GROUP BY ALL)
SELECT vec_id AS example_id, CAST(label AS INTEGER) AS y_true, CAST(cls AS INTEGER) AS y_pred FROM scored
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, cls) = 1"""))


# -- labels -----------------------------------------------------------------

def _p1(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("err_obj"))
    return L.to_labelled(e, "err_obj.k", "event_id").select(
        F.col("label").alias("event_id"), F.col("src").alias("k"))


_reg("P1_to_labelled", (_p1, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"))


def _p2(spark, sf):
    return L.to_labelled(labelled_text(spark, sf), "src", "label").select("src", "label")


_reg("P2_rebuild_records", (_p2, with_views("SELECT src, label FROM labelled_text", "labelled_text")))

# events.event_type as raw "messages" of a many-to-one map (fixed values).
EVENT_CLASS = {"click": "interaction", "view": "interaction", "purchase": "conversion",
               "signup": "conversion", "error": "failure"}


def _p3(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", L.map_labels("event_type", EVENT_CLASS).alias("label"))


_reg("P3_map_labels", (_p3, "SELECT event_id, CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' "
                            "WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'conversion' WHEN 'error' THEN 'failure' END "
                            "AS label FROM events"))


def _p4(spark, sf):
    lt = labelled_text(spark, sf)
    raw = F.when(F.col("split") == "valid", "dev").when(F.col("split") == "test", "eval").otherwise("train")
    return lt.select("ord", L.map_split_names(raw).alias("split"))


_reg("P4_map_split_names", (_p4, with_views("SELECT ord, split FROM labelled_text", "labelled_text")))


def _x10(spark, sf):
    lt = labelled_text(spark, sf)
    codes = L.label_codes(lt)
    return L.label_encode(lt, codes).select("ord", "label", "code")


_reg("X10_label_encode", (_x10, with_views(
    "SELECT t.ord, t.label, CAST(c.code AS INTEGER) AS code FROM labelled_text t JOIN (SELECT label, row_number() OVER "
    "(ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM labelled_text WHERE split = 'train')) c USING (label)",
    "labelled_text")))


def _x10_decode(spark, sf):
    lt = labelled_text(spark, sf)
    codes = L.label_codes(lt)
    coded = L.label_encode(lt, codes).select("ord", "code")
    return L.label_decode(coded, codes).select("ord", "code", "label")


_reg("X10_label_decode", (_x10_decode, with_views(
    "SELECT t.ord, CAST(c.code AS INTEGER) AS code, c.label FROM labelled_text t JOIN (SELECT label, row_number() OVER "
    "(ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM labelled_text WHERE split = 'train')) c USING (label)",
    "labelled_text")))


def _x11(spark, sf):
    # the words are written once: the vocabulary and the ids read them from there
    lt = cut_lineage(labelled_text(spark, sf).select("ord", "split", X.tokens("src").alias("words")))
    vocab = L.vocabulary(lt.where(F.col("split") == "train"), first_id=4, tokens_col="words")  # other words are unknown
    enc = L.encode_fixed_length(lt, vocab, "ord", max_length=512, tokens_col="words")
    return enc.select("ord", F.array_join("input_ids", " ").alias("ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"))


_reg("X11_encode_fixed_length", (_x11, with_views(
    "SELECT t.ord, array_to_string([0] || coalesce(s.ids, []) || [2] || list_transform(range(510 - coalesce(len(s.ids), 0)), "
    "lambda i: 1), ' ') AS ids, CAST(coalesce(len(s.ids), 0) + 2 AS INTEGER) AS n_attended FROM labelled_text t LEFT JOIN "
    "(SELECT ord, list(id ORDER BY p) AS ids FROM (SELECT e.ord, e.p, CAST(coalesce(v.id, 3) AS INTEGER) AS id FROM "
    "(SELECT ord, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS p FROM "
    f"(SELECT ord, regexp_extract_all(src, {S.sql_lit(X.TOKEN_PATTERN)}) AS toks FROM labelled_text)) e "
    "LEFT JOIN vocab v USING (token) WHERE e.p < 510) GROUP BY ord) s USING (ord)", "labelled_text",
    ctes=["vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT DISTINCT unnest("
          f"regexp_extract_all(src, {S.sql_lit(X.TOKEN_PATTERN)})) AS token FROM labelled_text WHERE split = 'train'))"])))


def _x8(spark, sf):
    c = table(spark, sf, "conversations")
    marked = F.concat_ws(" NEW_LINE ", F.col("role"), F.concat(F.lit("INDENT "), F.col("text"), F.lit(" DEDENT")))
    return c.select("conv_id", "turn", X.layout_tokens(marked).alias("out"))


def _x8_sql():
    """The same rule, set-based: depth = running sum of INDENT/DEDENT; a
    NEW_LINE ends up with the depth at the end of its segment (later markers
    rewrite the last newline); index 0 is the last-newline slot before the
    first NEW_LINE (a marker there leaves '' when it is the last one)."""
    cls = S.sql_lit(X.PY_SPACE + "+")
    sp = "CASE WHEN dend > 0 THEN repeat(' ' || chr(9) || ' ', CAST(dend AS INTEGER)) ELSE '' END"
    nl = f"(' ' || chr(10) || ' ' || {sp})"
    return (
        "WITH src AS (SELECT conv_id, turn, concat_ws(' NEW_LINE ', role, 'INDENT ' || text || ' DEDENT') AS s "
        "FROM conversations),\n"
        f"arr AS (SELECT conv_id, turn, {S.strip('s')} AS st FROM src),\n"
        f"toks AS (SELECT conv_id, turn, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS p FROM "
        f"(SELECT conv_id, turn, regexp_split_to_array(st, {cls}) AS a FROM arr WHERE st <> '')),\n"
        "k AS (SELECT *, CASE lower(t) WHEN 'new_line' THEN 1 WHEN 'indent' THEN 2 WHEN 'dedent' THEN 3 ELSE 0 END AS k "
        "FROM toks),\n"
        "d AS (SELECT *, sum(CASE k WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER w AS depth, "
        "sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER w AS seg FROM k "
        "WINDOW w AS (PARTITION BY conv_id, turn ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
        "e AS (SELECT *, last_value(depth) OVER (PARTITION BY conv_id, turn, seg ORDER BY p ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND UNBOUNDED FOLLOWING) AS dend, max(CASE WHEN seg = 0 AND k IN (2, 3) THEN p END) OVER "
        "(PARTITION BY conv_id, turn) AS l0 FROM d),\n"
        f"o AS (SELECT conv_id, turn, p, CASE WHEN k = 1 THEN {nl} WHEN p = 0 THEN (CASE WHEN l0 IS NULL THEN t "
        f"WHEN l0 = 0 THEN '' ELSE {nl} END) WHEN k IN (2, 3) THEN '' ELSE t END AS o FROM e)\n"
        "SELECT a.conv_id, a.turn, regexp_replace(coalesce(j.s, ''), ' +', ' ', 'g') AS out FROM arr a LEFT JOIN "
        "(SELECT conv_id, turn, string_agg(o, ' ' ORDER BY p) AS s FROM o GROUP BY conv_id, turn) j "
        "USING (conv_id, turn)")


_reg("X8_layout_tokens", (_x8, _x8_sql()))


def _x19(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.json_field("props", "$.k", "int").alias("k"))


_reg("X19_json_fields", (_x19, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"))

