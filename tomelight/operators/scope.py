"""What a user may see: soft deletes, assigned libraries, content restrictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_deleted(column: str = "deleted") -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def visible(books: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Not deleted and in an assigned library (assigned: library_id; None: an administrator sees all)."""
    kept = books.where(not_deleted())
    return kept if assigned is None else kept.join(assigned.select("library_id").distinct(), "library_id", "left_semi")


def lowered(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(F.trim(x)))


def overlaps(values: Column, wanted: list[str]) -> Column:
    """Two-valued: whether an array shares a value with a list, ignoring case; null arrays share none."""
    mine = F.array_compact(lowered(values))
    return F.coalesce(F.arrays_overlap(mine, F.array(*[F.lit(w.strip().lower()) for w in wanted])), F.lit(False)) if wanted else F.lit(False)


def restricted(books: DataFrame, exclude: dict[str, list[str]], allow: dict[str, list[str]], age: list[int] | None = None, age_column: str = "age_rating") -> DataFrame:
    """Content restrictions: nothing excluded in any dimension, one of the allowed in each given dimension, and an age
    rating below the lowest cap (unknown ages pass)."""
    for column, values in exclude.items():
        books = books.where(~overlaps(F.col(column), values))
    for column, values in allow.items():
        if values:
            books = books.where(overlaps(F.col(column), values))
    if age:
        books = books.where(F.col(age_column).isNull() | (F.col(age_column) < min(age)))
    return books
