"""Mixing sources to target weights by blocks (operator 5).

A source's documents, in a fixed pseudorandom order, form one stream of tokens (words), cut into blocks of
``block`` words; the last block of a source may be short. A source's target is its share by weight, at most
``limit`` times its size, the excess shared again by weight. The target fixes how many slots of the mix a source
fills; the slots of the mix are dealt to output shards by multinomial draws (see ``shard_counts``). A source's k-th
slot is pass ``k // blocks`` and place ``k % blocks``, and a pseudorandom permutation of the block indexes, one for
each source and pass, maps it to a block. Blocks then join documents by (source, block index). The last slot of a
source is trimmed so that its words come to its target, rounded down.

``limit`` passes at most are made, so no document is taken more than ``limit`` times its size. The permutation is
a keyed 4-round Feistel network with cycle walking: any slot's block, and any block's slot, is computed alone.

Scale: prefix sums run over (source, bucket) groups, where a bucket is a hash of doc_id and holds about
``bucket_rows`` rows; sources of any size are spread. One row a source (weights, sizes, targets) is the only thing
that a window holds whole.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; repeated rows are rows of their own; sources whose texts are all empty have target 0; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, every, fresh, materialize, numbered, partitions, small_batches, text_or_empty

#: Fixed values of the contract: weights by a source's rank, repeating.
WEIGHTS = (5, 2, 1)
ROUNDS = 4
_M = 0xFFFFFFFFFFFFFFFF


def word_count(text):
    return F.regexp_count(text, F.lit(f"[^{SPACE}]++")).cast("long")


def _mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of range(n) at ``index`` (or its inverse): a Feistel network walked until inside."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & _M))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots_for(target: int, size: int, block: int, key: int) -> tuple[int, int]:
    """(slots, words of the last slot to leave out) so that the slots' words come to ``target``."""
    if target <= 0:
        return 0, 0
    blocks = -(-size // block)
    short = blocks * block - size
    # the short block stands at one place of each pass; count its visits
    passes = -(-target // size) + 1
    at = [p * blocks + int(permute(np.array([blocks - 1]), blocks, key + p, inverse=True)[0]) for p in range(passes)]
    slots = -(-target // block)
    while slots * block - short * sum(a < slots for a in at) < target:
        slots += 1
    return slots, slots * block - short * sum(a < slots for a in at) - target


def shard_counts(totals: np.ndarray, slots_per_shard: int, shard: int, seed: int = 0) -> np.ndarray:
    """Slots that each source fills in one output shard.

    Multinomial draws conditioned on every source's total (so targets are met exactly): the shards are halved again
    and again, each half drawing its counts from its parent's without replacement. A shard's counts need only the
    draws on its own path, so shards are independent tasks.
    """
    remaining, n = np.asarray(totals, np.int64), int(np.sum(totals))
    low, high = 0, max(1, -(-n // slots_per_shard))
    while high - low > 1:
        middle = (low + high) // 2
        here = min((middle - low) * slots_per_shard, int(remaining.sum()))
        draw = np.random.default_rng([seed, low, middle, high])
        left = np.zeros_like(remaining)
        want, rest = here, int(remaining.sum())
        for i, c in enumerate(remaining.tolist()):
            rest -= c
            left[i] = _without_replacement(draw, c, rest, want)
            want -= int(left[i])
        remaining = left if shard < middle else remaining - left
        low, high = (low, middle) if shard < middle else (middle, high)
    return remaining


def _without_replacement(draw, good: int, bad: int, sample: int) -> int:
    """Hypergeometric, by numpy up to its limit and by its normal limit law beyond."""
    if not good or not sample:
        return 0
    if not bad:
        return sample
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, sample))
    total = good + bad
    mean = sample * good / total
    spread = (mean * (bad / total) * ((total - sample) / (total - 1))) ** 0.5
    return int(min(good, sample, max(sample - bad, 0, round(draw.normal(mean, spread)))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """(source, size) -> source, source_size, target.

    At the end each source has min(limit * size, level * weight) for one common level: sources in order of
    limit * size / weight are full up to some point, and the rest share what is left by weight. Windows over one
    row a source find the point.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * limit).cast("double"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    sums = ranked.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full_before"),
        F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    # the level if exactly the sources before this one are full; the first that its level doesn't fill sets it
    level = (F.col("total") - F.col("full_before")) / F.col("weight_from")
    found = F.min(F.when(F.col("most") / F.col("weight") >= level, F.struct("full_before", level.alias("level")))).over(everything)
    return sums.select("source", "source_size", F.least(F.col("most"), F.col("weight") * found["level"]).alias("target"))


def mix(docs: DataFrame, block: int = 64, limit: int = 3, slots_per_shard: int = 8192, bucket_rows: int = 5000, seed: int = 0, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents: rid, doc_id, source, size, source_size, target, start (place of its first word in the source's stream).
    row_id names a column that tells rows apart; without it rows are numbered as they are first written.

    slots: source, block, pass, shard, slot (its place in the shard), words (of the block that the slot takes).
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rid = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    sized = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"))
    sized = materialize(sized)
    rows = sized.count()
    buckets = max(1, -(-rows // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.col("rid"))), F.lit(buckets)).alias("bucket")
    spread = sized.select("*", bucket, F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"))
    sums = spread.groupBy("none", "key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("none", "key").orderBy("bucket")) - F.col("bucket_size")
    offsets = materialize(sums.select("none", "key", "source", "bucket", "bucket_size", earlier.alias("earlier")))
    sizes = offsets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = materialize(source_targets(sizes, limit=limit).select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target"))
    inside = F.sum("size").over(Window.partitionBy("none", "key", "bucket").orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    documents = spread.withColumn("inside", inside).join(offsets.drop("source", "bucket_size"), ["none", "key", "bucket"]).join(targets, ["none", "key"])
    documents = documents.select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("inside") + F.col("earlier")).alias("start"))
    return documents, _slots(targets, block, slots_per_shard, seed)


def _slots(targets: DataFrame, block: int, slots_per_shard: int, seed: int) -> DataFrame:
    spark = targets.sparkSession
    # a source's row: how many slots it fills, and what the last leaves out
    number = F.row_number().over(Window.orderBy("none", F.encode("key", "UTF-8"))) - 1

    def plan(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [slots_for(int(r["target"]), r["source_size"], block, _key(seed, r["number"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch[n] for n in ("none", "key", "number", "source_size")] + [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["none", "key", "number", "source_size", "slots", "left_out"])

    planned = targets.select("none", "key", "source_size", "target", number.cast("long").alias("number"))
    planned = materialize(planned.mapInArrow(plan, "none boolean, key string, number long, source_size long, slots long, left_out long"))
    totals = np.array([r.slots for r in planned.select("number", "slots").orderBy("number").collect()], np.int64)
    shards = max(1, -(-int(totals.sum()) // slots_per_shard))
    shared = spark.sparkContext.broadcast(totals)  # one number a source

    def draw(batches):
        for batch in batches:
            for shard in batch[0].to_pylist():
                counts = shard_counts(shared.value, slots_per_shard, shard, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), shard)), pa.array(np.arange(len(counts))), pa.array(counts)], ["shard", "number", "drawn"])

    width = min(shards, max(1, spark.sparkContext.defaultParallelism * 4))
    drawn = materialize(spark.range(0, shards, 1, width).mapInArrow(draw, "shard long, number long, drawn long").where("drawn > 0"))
    earlier = F.sum("drawn").over(Window.partitionBy("number").orderBy("shard")) - F.col("drawn")
    place = F.sum("drawn").over(Window.partitionBy("shard").orderBy("number")) - F.col("drawn")
    runs = drawn.select("shard", "number", "drawn", earlier.alias("first"), place.alias("place")).join(planned, "number")

    def fill(batches):
        for batch in batches:
            for r in batch.to_pylist():
                k = np.arange(r["first"], r["first"] + r["drawn"])
                blocks = -(-r["source_size"] // block)
                passes, places = k // blocks, k % blocks
                index = np.empty(len(k), np.int64)
                for p in np.unique(passes).tolist():
                    some = passes == p
                    index[some] = permute(places[some], blocks, _key(seed, r["number"]) + p)
                words = np.minimum(block, r["source_size"] - index * block)
                words[k == r["slots"] - 1] -= r["left_out"]
                names = [pa.array([r["key"]] * len(k), pa.string()), pa.array([r["none"]] * len(k), pa.bool_())]
                # slots of a shard are dealt among its sources in turn, not source after source
                yield pa.RecordBatch.from_arrays([*names, pa.array(index), pa.array(passes), pa.array(np.full(len(k), r["shard"])), pa.array(r["place"] + np.arange(len(k))), pa.array(words)], ["key", "none", "block", "pass", "shard", "slot", "words"])

    # a run is one short row but fills thousands of slots, so runs are dealt by number and not by size
    slots = runs.repartition(partitions(spark), "shard", "number").mapInArrow(fill, "key string, none boolean, block long, pass long, shard long, slot long, words long")
    return slots.select(F.when(~F.col("none"), F.col("key")).alias("source"), "block", "pass", "shard", "slot", "words")


def _key(seed: int, number: int) -> int:
    return (seed * 1_000_003 + number) * 1009


def taken_pieces(documents: DataFrame, slots: DataFrame, block: int = 64) -> DataFrame:
    """Blocks joined to documents by index: rid, pass, shard, slot, from_word and words (inside the document)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = documents.where("size > 0").select("rid", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    # both sides make many rows of one, which sizes of tables don't tell: neither may be broadcast
    found = parts.join(slots.hint("merge"), parts["source"].eqNullSafe(slots["source"]) & (parts["block"] == slots["block"])).select(
        "rid", "pass", "shard", "slot", "start", "size", parts["block"], "words"
    )
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    return found.select("rid", "pass", "shard", "slot", (begin - F.col("start")).alias("from_word"), (end - begin).alias("words")).where("words > 0")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The parts of a text from word a up to word b for each span (first word, words); touching spans are one part."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for first, count in sorted(spans):
        if merged and merged[-1][1] == first:
            merged[-1][1] = first + count
        else:
            merged.append([first, first + count])
    if merged == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, block: int = 64) -> DataFrame:
    """The mix as documents: for each pass in which words of a row are taken, the row with those words as its text.

    A row taken whole keeps its text; n_chars, if there is such a column, is the new text's length.
    """
    small_batches(docs.sparkSession)
    rid, taken = fresh(docs, "row_number", "taken_spans")
    base = materialize(docs.withColumn(rid, F.monotonically_increasing_id()))
    documents, slots = mix(base, block=block, row_id=rid)
    spans = taken_pieces(materialize(documents), slots, block).groupBy("rid", "pass").agg(F.collect_list(F.struct("from_word", "words")).alias(taken))
    joined = base.join(spans.select(F.col("rid").alias(rid), taken), rid).select(*every(docs), taken)
    names, place = docs.columns, docs.columns.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            found = [cut_words(t or "", [(s["from_word"], s["words"]) for s in spans]) for t, spans in zip(columns[place].to_pylist(), batch[len(names)].to_pylist(), strict=True)]
            columns[place] = pa.array(found, pa.string())
            if count is not None:
                columns[count] = pa.array([len(t) for t in found], pa.int64()).cast(columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return numbered(joined).mapInArrow(run, docs.schema)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    documents, slots = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    documents = materialize(documents)
    taken = taken_pieces(documents, slots).groupBy("rid").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
