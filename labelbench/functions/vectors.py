"""Array-column math used by pooling and scoring.

All higher-order functions (``transform``, ``aggregate``, ``zip_with``) are
JVM expressions: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def argmax(col) -> Column:
    """0-based index of the first greatest element (NaN counts as greatest)."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def cross_entropy(logits, y) -> Column:
    """-log softmax(logits)[y], shifted by the max for stability."""
    lg = _c(logits)
    # The max is bound once by the finish lambda, not re-evaluated per element.
    lse = F.aggregate(
        lg, F.lit(float("-inf")), lambda a, x: F.greatest(a, x),
        lambda m: F.log(F.aggregate(lg, F.lit(0.0), lambda a, x: a + F.exp(x - m))) + m)
    return lse - F.get(lg, _c(y))


def scale(col, w) -> Column:
    """Element-wise ``vec * w`` (``w`` a scalar column)."""
    w = _c(w) if not isinstance(w, (int, float)) else F.lit(float(w))
    return F.transform(_c(col), lambda x: x * w)


def zeros_like(col) -> Column:
    return F.transform(_c(col), lambda x: F.lit(0.0))


def vsum(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda a, x: a + x)


def layer_norm(col, eps: float = 1e-5, gamma: list | None = None, beta: list | None = None) -> Column:
    """V2: (x - mean) / sqrt(var_pop + eps), then optional scale and shift."""
    c = _c(col)
    n = F.size(c).cast("double")
    # Two passes, each bound once through a finish lambda: O(H) per vector.
    out = F.aggregate(
        c, F.lit(0.0), lambda a, x: a + x,
        lambda s: F.aggregate(
            c, F.lit(0.0), lambda a, x: a + (x - s / n) * (x - s / n),
            lambda q: F.transform(c, lambda x: (x - s / n) / F.sqrt(q / n + F.lit(eps)))))
    if gamma is not None:
        g = F.array(*[F.lit(float(v)) for v in gamma])
        out = F.zip_with(out, g, lambda x, y: x * y)
    if beta is not None:
        b = F.array(*[F.lit(float(v)) for v in beta])
        out = F.zip_with(out, b, lambda x, y: x + y)
    return out


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(col, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """V17 as an expression: ``W x + b`` with ``W`` (C x H) inlined as an array
    literal.  Meant for small heads; large heads use the Arrow path in
    operators.scoring."""
    W = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    out = F.transform(W, lambda row: dot(row, _c(col)))
    if bias is not None:
        b = F.array(*[F.lit(float(v)) for v in bias])
        out = F.zip_with(out, b, lambda x, y: x + y)
    return out
