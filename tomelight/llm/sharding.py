"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 8).

Each shard owns many points (virtual nodes) on a ring of hash values; a document belongs to the next point
clockwise of its own hash. A shard's bound is its exact share of the rows, so counts differ by one at most
(law ``rows``). A shard takes the documents of its own arcs first; those beyond its bound continue clockwise to the
next shard with room. Only overflow moves, and with one more shard most documents stay where they are.

Scale: what is gathered is one count an arc (shards x virtual nodes: fixed size). The walk around the ring on these
counts gives, for each arc, which ranks go to which shard and their first slot there. A document then needs only
its rank in its arc. An arc is dealt to as many buckets as its own count needs, by a hash of the whole row, and buckets that are
still too full (one row repeated) are dealt again by a number of the row, so an arc that holds a third of all rows (rows without
doc_id, or one row repeated) is spread like any other; ranks are found by windows over groups of about ``bucket_rows`` rows plus
bucket offsets.

Defined results: a null text has size 8 and the crc32 of no bytes; repeated rows are rows of their own, all on one
arc; null doc_ids hash like any value; fewer rows than shards leave some shards empty; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, text_or_empty

RING_BITS = 32
PART_BITS = 12


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order."""
    nodes = {}
    for shard in range(shards):
        for copy in range(virtual):
            place = int.from_bytes(sha256(f"{shard}/{copy}".encode()).digest()[: RING_BITS // 8], "big")
            nodes.setdefault(place, shard)
    return sorted(nodes.items())


def walk(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first slot) for the documents of each arc; bounds are exact shares."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, plan, beyond = [0] * shards, [], []

    def put(arc: int, start: int, count: int, shard: int) -> int:
        taken = min(count, room[shard])
        if taken:
            plan.append((arc, start, start + taken, shard, filled[shard]))
            filled[shard] += taken
            room[shard] -= taken
        return taken

    for arc, (_, shard) in enumerate(nodes):
        own = counts.get(arc, 0)
        kept = put(arc, 0, own, shard)
        if kept < own:
            beyond.append((arc, kept, own - kept))
    for arc, start, count in beyond:
        at = arc
        while count:
            at = (at + 1) % len(nodes)
            taken = put(arc, start, count, nodes[at][1])
            start, count = start + taken, count - taken
    return plan


def shard_documents(docs: DataFrame, shards: int = 24, virtual: int = 64, bucket_rows: int = 20_000) -> DataFrame:
    """One row a row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    spark = docs.sparkSession
    nodes = ring(shards, virtual)
    text = text_or_empty().cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 64 - RING_BITS).alias("place"),
        F.monotonically_increasing_id().alias("copy"),
    )
    # the ring is cut into 2**12 equal parts: a part lies within few arcs, found by a fixed-size table
    cuts = [p for p, _ in nodes]
    table = []
    for part in range(1 << PART_BITS):
        low, high = part << (RING_BITS - PART_BITS), (part + 1) << (RING_BITS - PART_BITS)
        a, b = bisect_left(cuts, low), bisect_left(cuts, high)
        edges = [low, *[c + 1 for c in cuts[a:b] if c + 1 < high]]
        table += [(part, x, (edges[i + 1] if i + 1 < len(edges) else high), bisect_left(cuts, x) % len(nodes)) for i, x in enumerate(edges)]
    arcs = F.broadcast(spark.createDataFrame(table, "part long, low long, high long, arc int"))
    rows = rows.withColumn("part", F.shiftright("place", RING_BITS - PART_BITS))
    rows = materialize(rows.join(arcs, "part").where("place >= low and place < high").drop("part", "low", "high", "place"))
    arc_counts = dict(rows.groupBy("arc").count().collect())
    plan = walk(nodes, arc_counts, shards)
    planned = F.broadcast(spark.createDataFrame(plan, "arc int, first long, last long, shard int, base long"))
    buckets = F.broadcast(spark.createDataFrame([(arc, -(-n // bucket_rows)) for arc, n in arc_counts.items()], "arc int, buckets int"))
    rows = rows.join(buckets, "arc").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), "buckets").cast("int"))
    full = rows.groupBy("arc", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > 4 * bucket_rows).select("arc", "bucket", F.ceil(F.col("n") / bucket_rows).alias("parts"))
    rows = rows.join(full, ["arc", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("copy"), F.coalesce("parts", F.lit(1))))
    key = ["arc", "bucket", "part"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    offsets = counts.select(*key, (F.sum("n").over(Window.partitionBy("arc").orderBy("bucket", "part")) - F.col("n")).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    ranked = rows.withColumn("inside", rank)
    ranked = ranked.join(offsets, key).withColumn("rank", F.col("inside") + F.col("earlier"))
    placed = ranked.join(planned, "arc").where("rank >= first and rank < last")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_hash_ring(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
