"""Pool per-layer, per-token vectors into one vector per example.

Input: ``hidden_states(example_id, layer, pos, mask, vec ARRAY<DOUBLE>)``
(layer 0 = embedding output, 1..L = encoder layers).  Output:
``(example_id, vec)``.

Element-wise sums and maxes run as ``pyspark.ml.stat.Summarizer`` aggregates
over ``array_to_vector`` columns: JVM-side, with partial aggregation per task,
so an example's rows are reduced before they are shuffled and vectors are
never exploded.  Weights (``w_tokens`` over positions, ``w_layers`` over
layers 1..L) are learned parameters of fixed size; they are multiplied into
the vector first (Summarizer rejects negative weight columns) and inlined as
array literals, so no join is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import layer_norm, scale, zeros_like

KEY = "example_id"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _w_at(weights, idx: Column) -> Column:
    """weights[idx] (0-based) from a literal array."""
    return F.element_at(_lit_array(weights), idx + 1)


def vsum(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise sum of ``vec`` per key."""
    return (df.groupBy(*keys).agg(Summarizer.sum(array_to_vector(F.col(vec))).alias("__s"))
            .select(*keys, vector_to_array("__s").alias(vec)))


def vmax(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise max of ``vec`` per key (zero vectors count as values)."""
    return (df.groupBy(*keys).agg(Summarizer.max(array_to_vector(F.col(vec))).alias("__s"))
            .select(*keys, vector_to_array("__s").alias(vec)))


def effective_mask(hs: DataFrame, special_tokens_to_zero: bool = False,
                   special: str = "reference") -> DataFrame:
    """V1 mask: padding (mask 0) always; with ``special_tokens_to_zero`` also
    position 0 and a second position.

    ``special='reference'``: the second position is (real tokens after
    clearing position 0) - 1, i.e. n-2 for n real tokens, and -1 wraps to the
    last position (the original indexes a tensor).  ``'first_last'``: the end
    token n-1.  If the table carries ``n_real`` (tokens per example, as V16
    writes it) no join is needed; otherwise it is counted once per example and
    joined back on ``example_id`` - the same key the pooling groups by, so the
    aggregates that follow reuse that partitioning.
    """
    if not special_tokens_to_zero:
        return hs.withColumn("eff_mask", F.col("mask"))
    if "n_real" in hs.columns and "n_pos" in hs.columns:
        stats = None
        n_real, n_pos = F.col("n_real"), F.col("n_pos")
        first_real = F.lit(1)
        d = hs
    else:
        tok = hs.select(KEY, "pos", "mask").distinct()
        stats = tok.groupBy(KEY).agg(F.sum("mask").alias("__n_real"), (F.max("pos") + 1).alias("__n_pos"),
                                     F.max(F.when(F.col("pos") == 0, F.col("mask"))).alias("__m0"))
        d = hs.join(stats, KEY)
        n_real, n_pos, first_real = F.col("__n_real"), F.col("__n_pos"), F.coalesce(F.col("__m0"), F.lit(0))
    if special == "reference":
        after = n_real - first_real - 1
        second = F.when(after < 0, n_pos + after).otherwise(after)
    elif special == "first_last":
        second = n_real - 1
    else:
        raise ValueError("special must be 'reference' or 'first_last'")
    eff = F.when((F.col("pos") == 0) | (F.col("pos") == second), F.lit(0)).otherwise(F.col("mask"))
    out = d.withColumn("eff_mask", eff)
    return out.drop("__n_real", "__n_pos", "__m0") if stats is not None else out


def _special_drop(hs: DataFrame, special: str) -> DataFrame:
    """``(example_id, pos, __drop)``: positions the special-token rule clears.
    Built from (example, pos, mask) only - no vectors move."""
    tok = hs.select(KEY, "pos", "mask").distinct()
    m = effective_mask(tok, True, special)
    return m.select(KEY, "pos", ((F.col("eff_mask") == 0) & (F.col("mask") == 1)).alias("__drop"))


def _per_position(hs: DataFrame, how: str, w_layers=None, norm: bool = False,
                  special_tokens_to_zero: bool = False, special: str = "reference") -> DataFrame:
    """Masked states of layers 1..L reduced over layers per (example, pos).

    The mask depends on (example, pos) only, so padding is cleared row by row,
    the layers are reduced with map-side combine, and only then are the special
    positions cleared - joining the small per-position table instead of
    shuffling every state row to its example first."""
    x = _norm(_padding_cleared(hs), norm)
    # a cleared vector is the shift after a norm with one, once for each layer's weight
    cleared = zeros_like("vec")
    if norm and norm is not True and norm[1] is not None:
        total = sum(w_layers) if w_layers is not None else 1.0
        cleared = F.array(*[F.lit(float(v) * total) for v in norm[1]])
    if w_layers is not None:
        x = x.withColumn("vec", scale("vec", _w_at(w_layers, F.col("layer") - 1)))
    carry = [c for c in ("n_real", "n_pos") if c in hs.columns]
    per_pos = (vsum if how == "sum" else vmax)(x, [KEY, "pos", *carry])
    if not special_tokens_to_zero:
        return per_pos
    if len(carry) == 2:  # tokens per example travel with the rows (V16): no join
        m = effective_mask(per_pos.withColumn("mask", F.lit(1)), True, special)
        drop = F.col("eff_mask") == 0
    else:
        m = per_pos.join(_special_drop(hs, special), [KEY, "pos"], "left")
        drop = F.coalesce(F.col("__drop"), F.lit(False))
    out = m.withColumn("vec", F.when(drop, cleared).otherwise(F.col("vec")))
    return out.select(KEY, "pos", "vec")


def mask_states(hs: DataFrame, special_tokens_to_zero: bool = False, special: str = "reference") -> DataFrame:
    """V1: masked vectors become zero vectors and stay in their group."""
    m = effective_mask(hs, special_tokens_to_zero, special)
    return m.withColumn("vec", F.when(F.col("eff_mask") == 0, zeros_like("vec")).otherwise(F.col("vec")))


def _norm(df: DataFrame, on) -> DataFrame:
    """``on``: False, True for a plain norm, or (scale, shift) with the learned values."""
    if not on:
        return df
    gamma, beta = (None, None) if on is True else on
    return df.withColumn("vec", layer_norm("vec", gamma=gamma, beta=beta))


def _padding_cleared(hs: DataFrame) -> DataFrame:
    """Encoder layers with the vectors of padding set to zero, row by row."""
    return _encoder_layers(hs).withColumn("vec", F.when(F.col("mask") == 0, zeros_like("vec")).otherwise(F.col("vec")))


def _encoder_layers(df: DataFrame) -> DataFrame:
    return df.where(F.col("layer") >= 1)


def one_layer_cls(hs: DataFrame, layer: int) -> DataFrame:
    """V3: position 0 of one layer, no mask (the filter reaches the scan)."""
    return hs.where((F.col("layer") == layer) & (F.col("pos") == 0)).select(KEY, "vec")


def one_layer_w_sum_tokens(hs, layer, w_tokens, norm=False, special_tokens_to_zero=False, special="reference"):
    """V4: sum over positions of w_tokens[pos] * vec at one layer."""
    x = _norm(mask_states(hs.where(F.col("layer") == layer), special_tokens_to_zero, special), norm)
    x = x.withColumn("vec", scale("vec", _w_at(w_tokens, F.col("pos"))))
    return _norm(vsum(x, [KEY]), norm)


def one_layer_max_pool_tokens(hs, layer, norm=False, special_tokens_to_zero=False, special="reference"):
    """V5: element-wise max over positions at one layer."""
    x = _norm(mask_states(hs.where(F.col("layer") == layer), special_tokens_to_zero, special), norm)
    return _norm(vmax(x, [KEY]), norm)


def w_sum_tokens_w_sum_layers(hs, w_tokens, w_layers, norm=False, special_tokens_to_zero=False,
                              special="reference"):
    """V6 (= V8 without norm): sum over layers and positions of wt[pos] wl[layer] vec.  Without
    clearing of special tokens the mask is a matter of the row, and one aggregate does."""
    if not special_tokens_to_zero:
        x = _norm(_padding_cleared(hs), norm)
        w = _w_at(w_layers, F.col("layer") - 1) * _w_at(w_tokens, F.col("pos"))
        return _norm(vsum(x.withColumn("vec", scale("vec", w)), [KEY]), norm)
    per_pos = _per_position(hs, "sum", w_layers, norm, special_tokens_to_zero, special)
    per_pos = per_pos.withColumn("vec", scale("vec", _w_at(w_tokens, F.col("pos"))))
    return _norm(vsum(per_pos, [KEY]), norm)


def w_sum_layers_w_sum_tokens(hs, w_tokens, w_layers, norm=False, special_tokens_to_zero=False,
                              special="reference"):
    """V8: layers first, then tokens; one weighted sum, the same plan as V6."""
    return w_sum_tokens_w_sum_layers(hs, w_tokens, w_layers, norm, special_tokens_to_zero, special)


def max_pool_layers_w_sum_tokens(hs, w_tokens, norm=False, special_tokens_to_zero=False, special="reference"):
    """V7: max over layers per (example, pos), then weighted sum over positions."""
    per_pos = _per_position(hs, "max", None, False, special_tokens_to_zero, special)
    per_pos = per_pos.withColumn("vec", scale("vec", _w_at(w_tokens, F.col("pos"))))
    return _norm(vsum(per_pos, [KEY]), norm)


def max_pool_tokens_w_sum_layers(hs, w_layers, norm=False, special_tokens_to_zero=False,
                                 special="reference", compat: bool = False):
    """V9: max over positions per (example, layer), then weighted sum over layers.

    ``compat=True`` repeats the original contraction, which sums the per-layer
    maxima and multiplies by the sum of all layer weights."""
    x = mask_states(_encoder_layers(hs), special_tokens_to_zero, special)
    per_layer = vmax(x, [KEY, "layer"])
    if compat:
        w = F.lit(float(sum(w_layers)))
    else:
        w = _w_at(w_layers, F.col("layer") - 1)
    return _norm(vsum(per_layer.withColumn("vec", scale("vec", w)), [KEY]), norm)


def max_pool_layers_max_pool_tokens(hs, norm=False, special_tokens_to_zero=False, special="reference"):
    """One element-wise max over layers 1..L and positions."""
    if not special_tokens_to_zero:
        return _norm(vmax(_padding_cleared(hs), [KEY]), norm)
    per_pos = _per_position(hs, "max", None, False, special_tokens_to_zero, special)
    return _norm(vmax(per_pos, [KEY]), norm)


def w_sum_cls(hs, w_layers, norm=False):
    """Weighted sum over layers 1..L of position 0, no mask."""
    x = hs.where((F.col("pos") == 0) & (F.col("layer") >= 1))
    x = x.withColumn("vec", scale("vec", _w_at(w_layers, F.col("layer") - 1)))
    return _norm(vsum(x, [KEY]), norm)


def max_pool_cls(hs, norm=False):
    """Element-wise max over layers 1..L of position 0, no mask."""
    x = hs.where((F.col("pos") == 0) & (F.col("layer") >= 1))
    return _norm(vmax(x, [KEY]), norm)


def last_layer_cls(hs: DataFrame, last_layer: int = 12, pooled_col: str | None = None) -> DataFrame:
    """A supplied pooled vector (pass-through) or position 0 of the last layer."""
    if pooled_col is not None:
        return hs.select(KEY, F.col(pooled_col).alias("vec")).dropDuplicates([KEY])
    return one_layer_cls(hs, last_layer)


def cutoff_layers_one_layer_cls(hs: DataFrame, k: int) -> DataFrame:
    """Keep layers <= k, then position 0 of layer k."""
    return one_layer_cls(hs.where(F.col("layer") <= k), k)


# Name -> pooling function, for callers that pick a combination by name.
POOLINGS = {
    "one_layer_cls": one_layer_cls,
    "one_layer_w_sum_tokens": one_layer_w_sum_tokens,
    "one_layer_max_pool_tokens": one_layer_max_pool_tokens,
    "w_sum_tokens_w_sum_layers": w_sum_tokens_w_sum_layers,
    "max_pool_layers_w_sum_tokens": max_pool_layers_w_sum_tokens,
    "w_sum_layers_w_sum_tokens": w_sum_layers_w_sum_tokens,
    "max_pool_tokens_w_sum_layers": max_pool_tokens_w_sum_layers,
    "max_pool_layers_max_pool_tokens": max_pool_layers_max_pool_tokens,
    "w_sum_cls": w_sum_cls,
    "max_pool_cls": max_pool_cls,
    "last_layer_cls": last_layer_cls,
    "cutoff_layers_one_layer_cls": cutoff_layers_one_layer_cls,
}


def encode_states(encoded: DataFrame, encoder=None, n_layers: int = 12, hidden: int = 768,
                  id_col: str = "ex_id", encoder_loader=None) -> DataFrame:
    """Run a supplied encoder over (input_ids, attention_mask) and emit one
    hidden-state row per (example, layer, position).

    ``encoder(ids: np.ndarray[B,S], mask: np.ndarray[B,S]) -> np.ndarray[L+1,B,S,H]``
    is called once per Arrow batch inside the task.  ``encoder_loader`` (a
    zero-argument function returning such an encoder, e.g. loading a model from
    a path) is called once per Python worker process instead.  ``n_real`` /
    ``n_pos`` are written with every row so V1 needs no join.
    """
    schema = (f"example_id long, layer int, pos int, mask int, n_real int, n_pos int, "
              f"vec array<double>")

    def run(batches):
        from ..functions.workers import cached
        enc = encoder if encoder_loader is None else cached(encoder_loader)
        for pdf in batches:
            if pdf.empty:
                continue
            ids = np.stack(pdf["input_ids"].to_numpy())
            msk = np.stack(pdf["attention_mask"].to_numpy())
            states = np.asarray(enc(ids, msk), dtype=np.float64)
            n_layers1, b, s, _ = states.shape
            ex = np.repeat(pdf[id_col].to_numpy(), s)
            rows = []
            for layer in range(n_layers1):
                rows.append(pd.DataFrame({
                    "example_id": ex.astype("int64"),
                    "layer": np.int32(layer),
                    "pos": np.tile(np.arange(s, dtype=np.int32), b),
                    "mask": msk.reshape(-1).astype("int32"),
                    "n_real": np.repeat(msk.sum(axis=1), s).astype("int32"),
                    "n_pos": np.int32(s),
                    "vec": list(states[layer].reshape(b * s, -1)),
                }))
            yield pd.concat(rows, ignore_index=True)

    return encoded.select(id_col, "input_ids", "attention_mask").mapInPandas(run, schema)


def explode_vectors(pooled: DataFrame, key: str = KEY, digits: int | None = 9) -> DataFrame:
    """(key, vec) -> (key, dim, value): the long form the SQL oracle compares."""
    out = pooled.select(key, F.posexplode("vec").alias("dim", "value"))
    return out.withColumn("value", F.round("value", digits)) if digits is not None else out
