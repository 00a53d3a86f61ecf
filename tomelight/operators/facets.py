"""Cascading facets: filters by field and mode, counts that ignore a facet's own filter, search, multi-key sort."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAP = 100


@dataclass(frozen=True)
class Facet:
    """A facet's values for a row: one text, or an array of them if ``many``."""

    name: str
    values: Column
    many: bool = False


def matches(facet: Facet, chosen: list[str], mode: str = "or") -> Column:
    """Whether a row has the chosen values: any ("or"), all ("and") or none ("not"). Single values ignore "and"."""
    wanted = F.array(*[F.lit(c) for c in chosen]).cast("array<string>")
    own = facet.values if facet.many else F.array(facet.values)
    own = F.coalesce(F.array_compact(own), F.array().cast("array<string>"))
    if mode == "and" and facet.many:
        return F.size(F.array_except(wanted, own)) == 0
    hit = F.coalesce(F.arrays_overlap(own, wanted), F.lit(False))
    return ~hit if mode == "not" else hit


def filtered(rows: DataFrame, facets: list[Facet], active: dict[str, list[str]], mode: str = "or", skip: str | None = None) -> DataFrame:
    tests = [matches(f, active[f.name], mode) for f in facets if active.get(f.name) and f.name != skip]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def facet_counts(rows: DataFrame, facets: list[Facet], active: dict[str, list[str]], mode: str = "or", cap: int = CAP) -> DataFrame:
    """(facet, value, n): each facet's counts under the others' filters, the ``cap`` most frequent values a facet.

    All facets share one pass: a row carries, for each facet, whether the other facets' filters hold.
    """
    tests = {f.name: matches(f, active[f.name], mode) if active.get(f.name) else F.lit(True) for f in facets}
    parts = []
    for f in facets:
        others = reduce(lambda a, b: a & b, [t for name, t in tests.items() if name != f.name], F.lit(True))
        own = F.array_distinct(F.coalesce(F.array_compact(f.values if f.many else F.array(f.values)), F.array().cast("array<string>")))
        own = F.when(others, own).otherwise(F.array().cast("array<string>"))
        parts.append(F.transform(own, _labelled(f.name)))
    counted = rows.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def _labelled(name: str):
    return lambda value: F.struct(F.lit(name).alias("facet"), value.alias("value"))


def searched(rows: DataFrame, columns: list[Column], words: str) -> DataFrame:
    """Rows of which some column contains the normalised words; fewer than two characters search nothing."""
    from ..functions.text import search_key

    if len(words.strip()) < 2:
        return rows
    wanted = search_key(F.lit(words))
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(search_key(c).contains(wanted), F.lit(False)) for c in columns]))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers: runs are padded to 20 digits."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def multi_sort(keys: list[tuple[Column, bool]]) -> list[Column]:
    """(column, descending) keys; nulls last when rising, first when falling."""
    return [c.desc_nulls_first() if falling else c.asc_nulls_last() for c, falling in keys]


def surname_first(author: Column) -> Column:
    return F.regexp_replace(author, r"^(.*)\s+(\S+)$", "$2, $1")
