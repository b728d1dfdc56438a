"""V1-V14 against numpy on small arrays."""
import numpy as np
import pytest

from labelbench.operators import pooling as PO

H, L, S = 4, 3, 4
rng = np.random.default_rng(3)
STATES = {ex: rng.standard_normal((L + 1, S, H)) for ex in range(3)}
STATES[2] = -np.abs(STATES[2]) - 0.1          # all-negative vectors: a masked row must give max 0
N_REAL = {0: 4, 1: 3, 2: 2}                   # example 1, 2 have padding
WT = [0.5, -1.0, 2.0, 0.25]
WL = [1.0, -0.5, 2.0]


def _df(spark):
    rows = []
    for ex, st in STATES.items():
        for layer in range(L + 1):
            for pos in range(S):
                rows.append((ex, layer, pos, int(pos < N_REAL[ex]), [float(x) for x in st[layer, pos]]))
    return spark.createDataFrame(rows, "example_id long, layer int, pos int, mask int, vec array<double>")


def _masked(ex, special=False):
    st = STATES[ex].copy()
    m = np.array([1 if p < N_REAL[ex] else 0 for p in range(S)])
    if special:
        m[0] = 0
        m[m.sum() - 1] = 0  # n-2 for n real tokens (index -1 wraps)
    return st * m[None, :, None]


def _collect(df):
    return {r.example_id: np.array(r.vec) for r in df.collect()}


def _check(got, want):
    assert set(got) == set(want)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("special", [False, True])
def test_pooling_family(spark, special):
    hs = _df(spark)
    wt, wl = np.array(WT), np.array(WL)
    sp = dict(special_tokens_to_zero=special)
    _check(_collect(PO.one_layer_w_sum_tokens(hs, 2, WT, **sp)),
           {e: np.einsum("sh,s->h", _masked(e, special)[2], wt) for e in STATES})
    _check(_collect(PO.one_layer_max_pool_tokens(hs, 2, **sp)), {e: _masked(e, special)[2].max(0) for e in STATES})
    _check(_collect(PO.w_sum_tokens_w_sum_layers(hs, WT, WL, **sp)),
           {e: np.einsum("lsh,s,l->h", _masked(e, special)[1:], wt, wl) for e in STATES})
    _check(_collect(PO.max_pool_layers_w_sum_tokens(hs, WT, **sp)),
           {e: np.einsum("sh,s->h", _masked(e, special)[1:].max(0), wt) for e in STATES})
    _check(_collect(PO.max_pool_tokens_w_sum_layers(hs, WL, **sp)),
           {e: np.einsum("lh,l->h", _masked(e, special)[1:].max(1), wl) for e in STATES})
    _check(_collect(PO.max_pool_tokens_w_sum_layers(hs, WL, compat=True, **sp)),
           {e: np.einsum("blh,s->bh", _masked(e, special)[None, 1:].max(2), wl)[0] for e in STATES})
    _check(_collect(PO.max_pool_layers_max_pool_tokens(hs, **sp)),
           {e: _masked(e, special)[1:].max((0, 1)) for e in STATES})


def test_masked_max_is_zero_for_negative_vectors(spark):
    got = _collect(PO.max_pool_layers_max_pool_tokens(_df(spark)))
    assert np.all(got[2] == 0.0)


def test_cls_family(spark):
    hs = _df(spark)
    _check(_collect(PO.one_layer_cls(hs, 3)), {e: STATES[e][3, 0] for e in STATES})
    _check(_collect(PO.w_sum_cls(hs, WL)), {e: np.einsum("lh,l->h", STATES[e][1:, 0], np.array(WL)) for e in STATES})
    _check(_collect(PO.max_pool_cls(hs)), {e: STATES[e][1:, 0].max(0) for e in STATES})
    _check(_collect(PO.last_layer_cls(hs, L)), {e: STATES[e][L, 0] for e in STATES})
    _check(_collect(PO.cutoff_layers_one_layer_cls(hs, 2)), {e: STATES[e][2, 0] for e in STATES})


def test_mask_positions_for_short_examples(spark):
    rows = []
    for ex, n in ((0, 1), (1, 2), (2, 3)):
        for pos in range(4):
            rows.append((ex, 1, pos, int(pos < n), [1.0]))
    hs = spark.createDataFrame(rows, "example_id long, layer int, pos int, mask int, vec array<double>")
    ref = {(r.example_id, r.pos): r.eff_mask for r in PO.effective_mask(hs, True).collect()}
    # n=1: position 0 cleared, the second index is -1 -> last position
    assert [ref[(0, p)] for p in range(4)] == [0, 0, 0, 0]
    assert [ref[(1, p)] for p in range(4)] == [0, 1, 0, 0]   # n=2: 0 and n-2=0 (already cleared)
    assert [ref[(2, p)] for p in range(4)] == [0, 0, 1, 0]   # n=3: 0 and 1 (n-2), the end token stays
    fl = {(r.example_id, r.pos): r.eff_mask for r in PO.effective_mask(hs, True, "first_last").collect()}
    assert [fl[(2, p)] for p in range(4)] == [0, 1, 0, 0]


def test_layer_norm_and_heads(spark):
    from labelbench.functions.vectors import layer_norm
    from labelbench.operators import scoring as SC
    x = [1.0, 2.0, 4.0, -3.0]
    df = spark.createDataFrame([(0, x)], "example_id long, vec array<double>")
    got = np.array(df.select(layer_norm("vec").alias("v")).first().v)
    a = np.array(x)
    np.testing.assert_allclose(got, (a - a.mean()) / np.sqrt(a.var() + 1e-5))
    W = [[0.5, -1, 0, 2], [1, 1, 1, 1]]
    b = [0.1, -0.2]
    lin = np.array(SC.score_linear(df, W, b).first().logits)
    np.testing.assert_allclose(lin, np.array(W) @ a + np.array(b))
    W1 = np.arange(16).reshape(4, 4) / 10
    dense = np.array(SC.score_dense_tanh(df, W1, np.zeros(4), np.array(W), b).first().logits)
    np.testing.assert_allclose(dense, np.array(W) @ np.tanh(W1 @ a) + np.array(b))


def test_encoder_states_carry_token_counts(spark):
    """V16 rows carry n_real/n_pos; masking from them equals masking by join."""
    rng2 = np.random.default_rng(5)
    emb = rng2.standard_normal((50, 3))

    def enc(ids, mask):
        x = emb[ids % 50] * mask[..., None]
        return np.stack([x, np.tanh(x), np.tanh(2 * x)])

    enc_df = spark.createDataFrame([(0, [0, 5, 7, 2, 1, 1], [1, 1, 1, 1, 0, 0]),
                                    (1, [0, 9, 2, 1, 1, 1], [1, 1, 1, 0, 0, 0])],
                                   "ex_id long, input_ids array<int>, attention_mask array<int>")
    states = PO.encode_states(enc_df, enc, n_layers=2, hidden=3)
    assert states.count() == 2 * 3 * 6
    for fn in (PO.max_pool_layers_max_pool_tokens,
               lambda h, **k: PO.w_sum_tokens_w_sum_layers(h, [1.0] * 6, [0.5, -1.0], **k)):
        a = _collect(fn(states, special_tokens_to_zero=True))
        b = _collect(fn(states.drop("n_real", "n_pos"), special_tokens_to_zero=True))
        _check(a, b)


def _layer_norm(x, gamma, beta):
    m, v = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - m) / np.sqrt(v + 1e-5) * gamma + beta


@pytest.mark.parametrize("special", [False, True])
def test_learned_norm(spark, special):
    """Scale and shift apply to every vector, cleared ones included."""
    hs = _df(spark)
    gamma, beta = [0.5, 2.0, -1.0, 1.5], [0.1, -0.2, 0.3, 1.0]
    norm = lambda x: _layer_norm(x, np.array(gamma), np.array(beta))
    more = dict(norm=(gamma, beta), special_tokens_to_zero=special)
    wt, wl = np.array(WT), np.array(WL)
    _check(_collect(PO.one_layer_w_sum_tokens(hs, 2, WT, **more)),
           {e: norm(np.einsum("sh,s->h", norm(_masked(e, special)[2]), wt)) for e in STATES})
    _check(_collect(PO.w_sum_tokens_w_sum_layers(hs, WT, WL, **more)),
           {e: norm(np.einsum("lsh,s,l->h", norm(_masked(e, special)[1:]), wt, wl)) for e in STATES})
    _check(_collect(PO.max_pool_layers_max_pool_tokens(hs, **more)),
           {e: norm(_masked(e, special)[1:].max((0, 1))) for e in STATES})
