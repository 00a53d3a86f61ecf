"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules: ASCII only.
SPACE = "\\x20\\x09-\\x0D"


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``; where that is unset, local sessions (tests) get one of their own.

    Other machines do not see a folder of this one, so on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and every later use sees the same rows."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that none of df's columns has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of df as they are named, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns renamed by place: maps over Arrow batches can't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: long texts make Spark's default of 10,000 rows too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Caches that outlive a task (encoders with their words), a dictionary each; workers are used again by other maps.
CACHES: list[dict] = []


def without_caches() -> None:
    """Called by maps that use none of them: a worker gives back what an earlier map has kept (hundreds of MB)."""
    for cache in CACHES:
        cache.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bits(column: Column, bits: int) -> Column:
    """The low bits of a 64-bit hash, as a long."""
    return F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (id, component): the smallest id that links reach, for every id on an edge.

    Alternates "large star" and "small star" steps (Kiveris et al. 2014): each is one grouping by node, the
    number of steps grows with the logarithm of the longest chain, and no group is gathered in a task: a step
    aggregates a minimum and joins it back. Each step is written to the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession
    schema = edges.selectExpr("cast(a as bigint) a", "cast(b as bigint) b")
    current = materialize(schema.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    if current.isEmpty():
        return spark.createDataFrame([], "id bigint, component bigint")
    before = None
    for _ in range(64):
        both = current.union(current.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").where("a <> b")
        current = materialize(small.union(least.selectExpr("a", "m b")).distinct())
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components are not settled after 64 rounds")
    return (
        current.selectExpr("a id", "b component").union(current.selectExpr("b id", "b component")).groupBy("id").agg(F.min("component").alias("component"))
    )
