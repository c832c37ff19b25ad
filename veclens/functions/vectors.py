"""Vector arithmetic on array columns, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_NORM_EPS = 1e-5
NORM_FLOOR = 1e-12
HALF_MAX = 65504.0
HALF_OVERFLOW = 65520.0
HALF_MIN_EXPONENT = -14
HALF_MANTISSA_BITS = 10
# A double has 53 bits: the first leaves 11 of them, the second those from 2**-24 up.
SPLIT = 2.0**42 + 1
TO_SUBNORMAL = 1.5 * 2.0**28


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda Spark would evaluate an outer expression again for every
    element; passing it through a one-element array avoids that.
    """
    return F.transform(F.array(value), body)[0]


def subtract(left: str | Column, right: str | Column) -> Column:
    """Element-wise difference: centring by a mean, or removing a bias."""
    return F.zip_with(as_column(left), as_column(right), lambda x, y: x - y)


def total(vector: str | Column) -> Column:
    return F.aggregate(as_column(vector), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(vector: str | Column) -> Column:
    return F.aggregate(as_column(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vector: str | Column) -> Column:
    return F.sqrt(squared_norm(vector))


def unit(vector: str | Column) -> Column:
    """The vector over its norm; norms under 1e-12 count as 1e-12."""
    column = as_column(vector)
    length = F.greatest(norm(column), F.lit(NORM_FLOOR))
    return bind(length, lambda n: F.transform(column, lambda x: x / n))


def layer_norm(vector: str | Column, eps: float = LAYER_NORM_EPS) -> Column:
    """Zero mean and unit population variance over the vector's own values."""
    column = as_column(vector)

    def scaled(centred: Column) -> Column:
        deviation = F.sqrt(squared_norm(centred) / F.size(centred) + F.lit(eps))
        return bind(deviation, lambda d: F.transform(centred, lambda x: x / d))

    mean = total(column) / F.size(column)
    return bind(bind(mean, lambda m: F.transform(column, lambda x: x - m)), scaled)


def round_half(value: Column) -> Column:
    """Rounds to the nearest IEEE half-precision value, ties to even.

    Spark has no half type. The spacing of halves around ``value`` is a power
    of two, so scaling by it, ``rint`` and scaling back are all exact.
    """
    x = value.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(HALF_MIN_EXPONENT))
    spacing = F.pow(F.lit(2.0), exponent - HALF_MANTISSA_BITS)
    rounded = F.rint(x / spacing) * spacing
    infinite = F.signum(x) * F.lit(float("inf"))
    return (
        F.when(F.isnan(x) | (x == 0), x)
        .when(F.abs(x) >= HALF_OVERFLOW, infinite)
        .otherwise(rounded)
        .cast("float")
    )


def to_half(vector: str | Column) -> Column:
    """Half-precision rounding of every element, kept as ``ARRAY<FLOAT>``."""
    return F.transform(as_column(vector), round_half)


def fits_half(vector: str | Column) -> Column:
    """True when every element is a finite half: not null or NaN, at most 65,504, and equal to its rounding.

    The same answer as ``round_half`` gives, by sums alone: a half has at most
    11 significant bits (Veltkamp's split of a double leaves such a value as it
    is) and is a multiple of the least subnormal. NaN is above every number.
    """
    def fits(x: Column) -> Column:
        significant = x * SPLIT - (x * SPLIT - x)
        multiple = (x + TO_SUBNORMAL) - TO_SUBNORMAL
        return x.isNotNull() & (F.abs(x) <= HALF_MAX) & (significant == x) & (multiple == x)

    return F.forall(as_column(vector).cast("array<double>"), fits)
