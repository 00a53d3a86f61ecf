"""Set operations: snapshots, tagged unions, zero-filled counts, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Short rows with much work in each, dealt evenly over all tasks: their file may be a single split."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt(rows: DataFrame, count: int, *columns: str, most: int = 500000) -> DataFrame:
    """``spread`` where ``count`` rows are expected: over so many tasks that one holds about ``most`` rows, however many there are."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-count // most)), *columns)


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def changed(old: DataFrame, new: DataFrame, keys: list[str], strict: list[str], timed: list[str] = ()) -> DataFrame:
    """Rows of ``new`` whose values differ. strict: both must be known. timed: a value that appears is a change, one that
    disappears is not."""
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in (*strict, *timed)])
    tests = [F.coalesce(F.col(c) != F.col(f"_old_{c}"), F.lit(False)) for c in (*strict, *timed)]
    tests += [F.col(f"_old_{c}").isNull() & F.col(c).isNotNull() for c in timed]
    return new.join(o, keys).where(reduce(lambda a, b: a | b, tests)).select(*new.columns)


def compare(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key with its change: added, removed, changed (not null-safely equal) or same; one full join."""
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed").otherwise("same")
    return o.join(n, keys, "full").select(*keys, kind.alias("change"))


def union_tagged(sources: dict[str, DataFrame], tag: str) -> DataFrame:
    frames = [df.select(F.lit(name).alias(tag), "*") for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def zero_filled(universe: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """Counts of rows for every key of the universe."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return universe.join(counted, key, "left").select(*universe.columns, F.coalesce("_n", F.lit(0)).alias(count))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], newer: str | None = None) -> DataFrame:
    """Stored rows with the incoming ones in place; ``newer``: a column by which the later row stays."""
    columns = [c for c in stored.columns if c not in keys]
    o = stored.select(*keys, F.struct(*columns).alias("o"))
    n = incoming.select(*keys, F.struct(*columns).alias("n"))
    later = F.lit(True) if newer is None else F.coalesce(F.col(f"n.{newer}") >= F.col(f"o.{newer}"), F.col("o").isNull())
    chosen = F.when(F.col("n").isNotNull() & later, F.col("n")).otherwise(F.col("o"))
    return o.join(n, keys, "full").select(*keys, chosen.alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])


def purged(rows: DataFrame, cutoff) -> DataFrame:
    """Without rows soft-deleted before the cutoff."""
    return rows.where(~F.coalesce(F.col("deleted") & (F.col("deleted_at") < cutoff), F.lit(False)))


def without_orphans(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return rows.join(mapping.select(key), key, "left_semi")


def bulk_set(rows: DataFrame, ids: DataFrame, key: str, values: dict) -> DataFrame:
    """Set columns of the rows whose key is among the ids."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])
