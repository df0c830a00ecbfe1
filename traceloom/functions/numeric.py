"""Numeric expressions and closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.text import as_col


def clamp(value: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def flag(condition: Column) -> Column:
    """1.0 when true, else 0.0 (also for null)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def share(condition: Column) -> Column:
    """Share of rows of the group where the condition holds."""
    return F.avg(flag(condition))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """Quotient with a fixed value for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def wilson_lower(successes: Column, count: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval; zero without observations."""
    rate = successes / count
    spread = F.lit(z) * F.sqrt((rate * (1 - rate) + z * z / (4 * count)) / count)
    bound = (rate + z * z / (2 * count) - spread) / (1 + z * z / count)
    return F.when(count == 0, F.lit(0.0)).otherwise(bound)


def binary_entropy(p: Column | str) -> Column:
    value = as_col(p)
    inside = (value > 0) & (value < 1)
    entropy = -value * F.ln(value) - (1 - value) * F.ln(1 - value)
    return F.when(inside, entropy).otherwise(F.lit(0.0))


def softmax(values: Column | str) -> Column:
    """Softmax of an array, shifted by its maximum."""
    array = as_col(values)
    top = F.array_max(array)
    powers = F.transform(array, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def softplus_negative(value: Column | str) -> Column:
    """log(1 + exp(-x)) without overflow."""
    x = as_col(value)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def equal_width_bin(value: Column | str, bins: int) -> Column:
    """Bin number in [0, bins); the last bin also holds the upper end.

    The bin edges are the doubles i/bins, so a value equal to an edge opens its bin.
    """
    x = as_col(value)
    guess = F.floor(x * bins).cast("int")
    down = F.when(x < guess / F.lit(float(bins)), guess - 1).otherwise(guess)
    up = F.when(x >= (down + 1) / F.lit(float(bins)), down + 1).otherwise(down)
    return F.least(up, F.lit(bins - 1))
