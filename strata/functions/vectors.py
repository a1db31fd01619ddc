"""Column expressions on vectors and stacks of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null if the lengths differ."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def layer(layers: Column, index: int) -> Column:
    """One layer of a stack of layers."""
    return F.get(layers, F.lit(index))


def layer_slice(vec: Column, index: int, dim: int) -> Column:
    """One layer of a flattened stack."""
    return F.slice(vec, index * dim + 1, dim)


def flatten_layers(layers: Column) -> Column:
    return F.flatten(layers)


def fuse(layers: Column, weights: Sequence[float]) -> Column:
    """Weighted sum of unit-length layers; the weights are scaled to a sum of 1."""
    total = sum(weights)
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("layer weights must be non-negative with a positive sum")
    parts = F.zip_with(layers, F.array(*[F.lit(w / total) for w in weights]), lambda v, w: F.transform(l2_normalise(v), lambda x: x * w))
    zero = F.transform(F.get(layers, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(parts, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def weighted_sum(layers: Column, weights: Column) -> Column:
    """Plain weighted sum of layers, without scaling."""
    parts = F.zip_with(layers, weights, lambda v, w: F.transform(doubles(v), lambda x: x * w))
    zero = F.transform(F.get(layers, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(parts, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def confidence(r2: Column) -> Column:
    return F.when(r2 > 0.8, "high").when(r2 > 0.5, "medium").otherwise("low")


def tempo_level(bpm: Column) -> Column:
    """log2(bpm / 60) of a tempo held within 40 to 240."""
    return F.log2(F.least(F.greatest(bpm, F.lit(40.0)), F.lit(240.0)) / 60.0)


def has_shape(layers: Column, n_layers: int, dim: int) -> Column:
    return (F.size(layers) == n_layers) & F.forall(layers, lambda v: F.size(v) == dim)


def require_shape(layers: Column, n_layers: int, dim: int, source: Column) -> Column:
    """The layers, or an error that names the source row."""
    wrong = F.concat(F.lit("wrong embedding shape in "), source.cast("string"))
    return F.when(has_shape(layers, n_layers, dim), layers).otherwise(F.raise_error(wrong).cast("array<array<double>>"))


def median_of_window(x: Column, k: int) -> Column:
    """Running median of k values with the edge values repeated."""
    half = k // 2
    n = F.size(x)
    at = lambda i: F.get(x, F.least(F.greatest(i, F.lit(0)), n - 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.array_sort(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: at(i + d))), F.lit(half)))


def gaussian_smooth(x: Column, sigma: float = 3.0, truncate: float = 4.0) -> Column:
    """Gaussian filter with the edge values repeated."""
    import math

    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    w = [v / sum(w) for v in w]
    n = F.size(x)
    terms = lambda i: F.zip_with(F.sequence(F.lit(-radius), F.lit(radius)), F.array(*map(F.lit, w)), lambda d, v: F.get(x, F.least(F.greatest(i + d, F.lit(0)), n - 1)) * v)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(terms(i), F.lit(0.0), lambda s, v: s + v))


def savgol_smooth(x, window: int = 51, order: int = 3):
    """Polynomial smoothing of a numpy array; the edges take the values of the polynomial of the first or last window.

    The window shrinks to the largest odd one that fits; below five values
    the array stays as it is.
    """
    import numpy as np

    window = min(window, len(x) if len(x) % 2 else len(x) - 1)
    if window < 5:
        return x
    half = window // 2
    powers = np.vander(np.arange(window) - half, order + 1, increasing=True)
    fit = np.linalg.pinv(powers)
    out = np.convolve(x, fit[0][::-1], mode="same")
    out[:half], out[-half:] = (powers @ (fit @ x[:window]))[:half], (powers @ (fit @ x[-window:]))[-half:]
    return out
