"""Column helpers for numbers where NaN, infinities and null all mean missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number as double; null if it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale; null unless the denominator is above zero."""
    return F.when(den > 0, finite(num) / finite(den) * F.lit(scale))


def clamp(c: Column, low: float, high: float) -> Column:
    """c within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def half_up(c: Column) -> Column:
    """Rounding where halves go up."""
    return F.floor(c + 0.5)


def interpolate(c: Column, curve: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points of a curve, flat beyond its ends; null for a missing number."""
    x = finite(c)
    out = F.when(x <= curve[0][0], F.lit(float(curve[0][1])))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(curve[-1][1]))))


def mean_of(parts: list[Column], neutral: float = 50.0) -> tuple[Column, Column]:
    """(mean of what is there, or the neutral value; how many are there)."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(F.lit(neutral)), n
