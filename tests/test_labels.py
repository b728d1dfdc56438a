"""P3, P4, X10, X11."""
import pytest


from labelbench.operators import labels as L


def test_encode_lengths(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b c d"), (3, "a b c d e f g")], "ord long, src string")
    vocab = L.vocabulary(df, first_id=4)  # a..g -> 4..10
    got = {r.ord: (r.input_ids, r.attention_mask) for r in L.encode_fixed_length(df, vocab, "ord", max_length=6).collect()}
    assert got[1] == ([0, 4, 5, 2, 1, 1], [1, 1, 1, 1, 0, 0])      # shorter: padded
    assert got[2] == ([0, 4, 5, 6, 7, 2], [1] * 6)                  # exactly max_length
    assert got[3] == ([0, 4, 5, 6, 7, 2], [1] * 6)                  # longer: truncated
    no_pad = L.encode_fixed_length(df.where("ord = 1"), vocab, "ord", max_length=6, pad_id=None).first()
    assert no_pad.input_ids == [0, 4, 5, 2, 2, 2]                   # pad falls back to the end token


def test_label_codes_sort_by_type(spark):
    df = spark.createDataFrame([(1, "train"), (10, "train"), (2, "train"), (2, "test")], "label int, split string")
    codes = {r.label: r.code for r in L.label_codes(df).collect()}
    assert codes == {1: 0, 2: 1, 10: 2}
    enc = L.label_encode(df, L.label_codes(df))
    assert sorted((r.label, r.code) for r in enc.collect()) == [(1, 0), (2, 1), (2, 1), (10, 2)]
    dec = L.label_decode(enc.select("code"), L.label_codes(df))
    assert sorted(r.label for r in dec.collect()) == [1, 2, 2, 10]
    bad = spark.createDataFrame([(7, "test")], "label int, split string")
    with pytest.raises(Exception, match="unknown label"):
        L.label_encode(bad, L.label_codes(df)).collect()


def test_maps_raise_on_unknown(spark):
    df = spark.createDataFrame([("unexpected indent",), ("invalid syntax",)], "m string")
    assert [r[0] for r in df.select(L.map_labels("m")).collect()] == ["indentation error", "invalid syntax"]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("oops",)], "m string").select(L.map_labels("m")).collect()
    sp = spark.createDataFrame([("dev",), ("eval",), ("train",)], "s string")
    assert [r[0] for r in sp.select(L.map_split_names("s")).collect()] == ["valid", "test", "train"]



def test_null_label_encodes(spark):
    df = spark.createDataFrame([(None, "train"), ("a", "train")], "label string, split string")
    out = sorted((r.label or "", r.code) for r in L.label_encode(df, L.label_codes(df)).collect())
    assert out == [("", 0), ("a", 1)]


def test_encoding_against_python(spark):
    import random
    import regex
    from labelbench.functions.text import TOKEN_PATTERN
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "délta", "x_1", "42", ",", "!", "zeta"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(texts, "ord long, src string")
    max_len = 8
    import re
    py_pattern = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\u%04x" % int(m.group(1), 16), TOKEN_PATTERN)
    pat = regex.compile(py_pattern)
    toks = {i: pat.findall(t) for i, t in texts}
    vocab = {w: j + 4 for j, w in enumerate(sorted({w for ts in toks.values() for w in ts},
                                                    key=lambda w: w.encode("utf-8")))}
    got = {r.ord: (r.input_ids, r.attention_mask)
           for r in L.encode_fixed_length(df, L.vocabulary(df, first_id=4), "ord", max_length=max_len).collect()}
    for i, ts in toks.items():
        ids = [0] + [vocab[w] for w in ts[: max_len - 2]] + [2]
        want = (ids + [1] * (max_len - len(ids)), [1] * len(ids) + [0] * (max_len - len(ids)))
        assert got[i] == want, (i, ts)


def test_vocabulary_of_words_with_one_beginning(spark):
    """Ranges are cut by the words themselves: no partition holds much more than the others."""
    words = [f"prefix__{i:05d}" for i in range(6000)] + ["", "z", "é", "Z"]
    df = spark.createDataFrame([(w,) for w in words * 2], "w string").repartition(5)
    out = L.dense_ranks(df, "w", "n", 7)
    want = {w: i + 7 for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    assert {r.w: r.n for r in out.collect()} == want
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = [len(p) for p in df.distinct().repartitionByRange("w").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(parts) > 4 and max(parts) <= 2 * sorted(parts)[len(parts) // 2]
    assert L.dense_ranks(df.limit(0), "w", "n").count() == 0


def _moved(df):
    """Rows written to the shuffles of the plan that has run."""
    def of(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return of(node.executedPlan() if kind.startswith("Adaptive") else node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_encoding_moves_no_row_for_every_word(spark):
    """A word that is in every text, again and again, where the vocabulary is too large for a broadcast."""
    texts = [(i, "the " * (i % 90) + f"w{i} the", "null" if i % 7 else None) for i in range(1200)] + [(None, "the", None), (5000, None, None), (5001, "", None)]
    df = spark.createDataFrame(texts, "ord long, src string, x string").repartition(3).cache()
    vocab = L.vocabulary(df.where("ord % 2 = 0"), first_id=4)
    ids = {r.token: r.id for r in vocab.collect()}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        out = L.encode_fixed_length(df, vocab, "ord", max_length=64)
        got = {r.ord: (r.input_ids, r.attention_mask) for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(texts)
    for i, text, _ in texts:
        want = [0] + [ids.get(w, 3) for w in (text or "").split()[:62]] + [2]
        assert got[i] == (want + [1] * (64 - len(want)), [1] * len(want) + [0] * (64 - len(want)))
    assert _moved(out) < 10_000  # 44,000 words


def test_encoding_of_token_columns(spark):
    """Null tokens are unknown, null arrays empty; ids of any type; an empty table gives no rows."""
    df = spark.createDataFrame([("a", ["x", None, "y"]), ("b", None), ("c", []), (None, ["y"])], "k string, t array<string>").coalesce(1)
    vocab = L.vocabulary(df, first_id=4, tokens_col="t").where("token is not null")
    n = {r.token: r.id for r in vocab.collect()}
    out = L.encode_fixed_length(df, vocab, "k", max_length=4, tokens_col="t")
    assert {r.k: r.input_ids for r in out.collect()} == {"a": [0, n["x"], 3, 2], "b": [0, 2, 1, 1], "c": [0, 2, 1, 1], None: [0, n["y"], 2, 1]}
    assert L.encode_fixed_length(df.limit(0), vocab, "k", tokens_col="t").count() == 0
