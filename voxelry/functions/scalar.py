"""Column expressions shared by the operators; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap(level: Column, low: Column, high: Column) -> Column:
    """The point of [low, high] nearest to ``level``."""
    return F.greatest(low, F.least(level, high))


def cell_kind(ex: str = "ex", ey: str = "ey", ez: str = "ez") -> Column:
    """Dimension of a cell: how many of its coordinates are odd."""
    return F.col(ex) % 2 + F.col(ey) % 2 + F.col(ez) % 2


def expanded(n: Column) -> Column:
    """Cells along an axis of n voxels."""
    return 2 * n - 1


def span_gap(pair: Sequence[Column], rest: Sequence[Column]) -> Column:
    """Distance between the interval of ``pair`` and the span of ``rest``; above 0 where they do not meet."""
    low, high = (F.least(*rest), F.greatest(*rest)) if len(rest) > 1 else (rest[0], rest[0])
    return F.greatest(F.least(*pair) - high, low - F.greatest(*pair))


def quantised(value: Column, low: float, width: float, top: int = 255) -> Column:
    """A level from 0 to ``top`` by the floor of the value's place in [low, low + width]."""
    return F.floor(top * F.least(F.greatest((value.cast("double") - low) / width, F.lit(0.0)), F.lit(1.0))).cast("int")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; 0 and 0 for no trials."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(p.isNull(), 0.0).otherwise(F.greatest(middle - half, F.lit(0.0))), F.when(p.isNull(), 0.0).otherwise(F.least(middle + half, F.lit(1.0)))


def cells_of(w: Column, h: Column, d: Column) -> Column:
    """Cells of the expanded grid of a w by h by d volume."""
    return expanded(w) * expanded(h) * expanded(d)


def tips(w: Column, h: Column, d: Column, seconds: Column, guaranteed: Column) -> Column:
    """Guaranteed cells a second, 0 where well-composedness is not guaranteed."""
    return F.when(guaranteed & (seconds > 0), cells_of(w, h, d) / seconds).otherwise(0.0)


def scientific(value: Column) -> Column:
    """``c×10^e`` with two decimals."""
    e = F.floor(F.log10(value))
    return F.when(value > 0, F.format_string("%.2f×10^%d", value / F.pow(F.lit(10.0), e), e)).otherwise("0")


def speedup(base: Column, other: Column) -> Column:
    """How many times faster, two decimals, null where either is null or 0."""
    return F.bround(base / F.nullif(other, F.lit(0.0)), 2)
