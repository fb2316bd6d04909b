"""Float arrays: 8-bit blocks of 32, exact integer dots, reductions in a fixed order, norms and rotations.

Sums over FLOAT columns depend on the order of rows and accumulate in DOUBLE. The
reductions here are folds over an array in a fixed order, each step rounded to FLOAT, so no
partitioning changes a bit.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

BLOCK = 32
LANES = 8


def as_float(c: Column) -> Column:
    return c.cast("float")


def finite(values: Column) -> Column:
    """Whether no value is NaN, infinite or null."""
    return ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def blocks(values: Column, size: int = BLOCK) -> Column:
    """array<array<float>> of consecutive blocks; the length is a multiple of size."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / size).cast("int") - 1), lambda b: F.slice(values, b * size + 1, size))


def q8_scale(block: Column) -> Column:
    """The largest absolute value over 127, rounded once to FLOAT."""
    return as_float(F.array_max(F.transform(block, lambda x: F.abs(x))) / F.lit(127.0).cast("float"))


def q8_values(block: Column, scale: Column) -> Column:
    """x / scale rounded half away from zero, within -127 .. 127; zeros for a zero scale."""

    def one(x: Column) -> Column:
        y = as_float(x / scale)
        rounded = as_float(y + F.when(y < 0, F.lit(-0.5).cast("float")).otherwise(F.lit(0.5).cast("float"))).cast("int")
        return F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), rounded)))

    return F.transform(block, one)


def int_dot(a: Column, b: Column) -> Column:
    """Exact integer dot product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def lane_sum(values: Column, lanes: int = LANES) -> Column:
    """Sum of FLOATs: lane k takes elements k, k + 8 .. in order, and the lanes meet in a fixed tree."""
    zero = F.lit(0.0).cast("float")

    def lane(k: int) -> Column:
        own = F.filter(values, lambda x, i: i % lanes == k)
        return F.aggregate(own, zero, lambda s, x: as_float(s + x))

    parts = [lane(k) for k in range(lanes)]
    while len(parts) > 1:
        parts = [as_float(a + b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return parts[0]


def dot_float(a: Column, b: Column) -> Column:
    """Dot product with FLOAT products and lane_sum."""
    return lane_sum(F.zip_with(a, b, lambda x, y: as_float(x * y)))


def fold(values: Column, f: Callable[[Column], Column]) -> Column:
    """Sum of f(x) in DOUBLE, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once also where f uses it for every element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rms_norm(values: Column, eps: float = 1e-5) -> Column:
    """array<double>: x / sqrt(mean(x * x) + eps)."""
    scale = 1 / F.sqrt(fold(values, lambda x: x * x) / F.size(values) + eps)
    return let(scale, lambda s: F.transform(values, lambda x: x.cast("double") * s))


def log_softmax(values: Column) -> Column:
    """array<double>: x - max - ln(sum of exp(x - max))."""
    shift = lambda top: top + F.ln(fold(values, lambda x: F.exp(x - top)))
    return let(let(F.array_max(values).cast("double"), shift), lambda s: F.transform(values, lambda x: x.cast("double") - s))


def softmax_frequencies(values: Column, scale: int = 1 << 24, least: float = -88.0) -> Column:
    """array<bigint>: 1 + floor(softmax * scale), for an integer CDF; exponents stop at `least`."""
    weigh = lambda top: F.transform(values, lambda x: F.exp(F.greatest(x.cast("double") - top, F.lit(least))))
    share = lambda each: let(fold(each, lambda x: x), lambda total: F.transform(each, lambda x: F.floor(x / total * scale).cast("bigint") + 1))
    return let(let(F.array_max(values).cast("double"), weigh), share)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def rotate_pairs(values: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary embedding of adjacent pairs: pair j of n values turns by position * base ** (-2 j / n)."""
    n = F.size(values)

    def one(i: Column) -> Column:
        j = F.floor(i / 2)
        angle = position * F.pow(F.lit(base), -2.0 * j / n)
        even, odd = F.get(values, (2 * j).cast("int")).cast("double"), F.get(values, (2 * j + 1).cast("int")).cast("double")
        return F.when(i % 2 == 0, even * F.cos(angle) - odd * F.sin(angle)).otherwise(even * F.sin(angle) + odd * F.cos(angle))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def require_finite(values: Column, what: str = "a vector") -> Column:
    """The values; raises where one is NaN, infinite or null."""
    return F.when(finite(values), values).otherwise(F.raise_error(F.lit(f"{what} has a value that is not finite")).cast("array<float>"))


def rms_norm_float(values: Column, weights: Column, eps: float = 1e-5) -> Column:
    """array<float>: (x * r) * w with r = 1 / sqrt(mean + eps) in FLOAT; squares are added in lanes."""
    mean = as_float(dot_float(values, values) / F.size(values).cast("float"))
    r = as_float(F.lit(1.0).cast("float") / as_float(F.sqrt(as_float(mean + F.lit(eps).cast("float")))))
    return let(r, lambda s: F.zip_with(values, weights, lambda x, w: as_float(as_float(x * s) * w)))


def add_floats(a: Column, b: Column) -> Column:
    """Element sums in FLOAT: a residual or a bias."""
    return F.zip_with(a, b, lambda x, y: as_float(x + y))


def rotate_halves(values: Column, position: Column, dims: int, base: float = 10000.0) -> Column:
    """Rotary embedding of the first `dims` values: j turns with j + dims / 2; the rest stays."""
    half = dims // 2

    def one(i: Column) -> Column:
        j = i % half
        angle = position * F.pow(F.lit(base), -2.0 * j / dims)
        low, high = F.get(values, j.cast("int")).cast("double"), F.get(values, (j + half).cast("int")).cast("double")
        return F.when(i >= dims, F.get(values, i).cast("double")).when(i < half, low * F.cos(angle) - high * F.sin(angle)).otherwise(low * F.sin(angle) + high * F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), one)


def running_sums(values: Column) -> Column:
    """array<bigint>: of each place the sum of those before it."""
    return _running_sums(values)


@F.pandas_udf(ArrayType(LongType()))
def _running_sums(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.cumsum(v) - v)


def key_head(head: Column, heads: int, key_heads: int) -> Column:
    """The key head that a query head shares: consecutive groups of heads / key_heads."""
    if heads % key_heads:
        raise ValueError("the heads are no multiple of the key heads")
    return F.floor(head / (heads // key_heads)).cast("int")
