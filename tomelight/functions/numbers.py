"""Rounding, bands and small statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Half away towards plus infinity, unlike Spark's round for negative ties."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale


def banded(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Label of the first band with low <= value <= high; null outside all of them (gaps are kept)."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        label = F.when(value.between(low, high), F.lit(name)).otherwise(label)
    return label


def upper_middle(values: Column) -> Column:
    """sorted[n / 2] of an array."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def by_index(values: Column, share: float) -> Column:
    """sorted[floor(n * share)] of an array: a quartile by index."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) * share) + 1).cast("int"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 for fewer than two points or no spread."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))
