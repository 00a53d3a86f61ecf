"""Lexical retrieval packing: BM25 neighbours fill a seed document's window (operator 2).

1. Every document is encoded once and written; each task adds the document frequency of every id it saw. The sums
   (one number an id of the vocabulary: fixed size) give the BM25 statistics of the whole corpus.
2. A document fills whole windows by itself as far as it can; those never move. What is left of it, under one window
   of ids, goes on, so that a task's share doesn't depend on how long its documents are. A rest takes the distinct ids
   of its whole document and their counts along: they, not the rest's own ids, are its key, its postings and its query.
   The rests are range-partitioned by a lexical key: three min-hashes of the document's ids, then a hash of doc_id, so
   like ones come together and a large group of copies still spreads over tasks. Within a partition, runs of
   ``shard_tokens`` ids (or as many postings) form the shards; a shard's inverted index is all that a task holds.
3. In a shard, the next unused rest (in key order) is the seed. Its document's ids query the index; unused neighbours
   by falling score fill the window. A document that overflows is cut, and what is left of it seeds the next window.
   The last window of a shard is cut into powers of two, which need no padding.

Defined results: a null or empty text has the end id only; repeated rows are packed once each; documents that share
no weighted id with a seed still serve, in key order, when no neighbour is left; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, partitions, small_batches, text_or_empty
from ._tokens import default_vocabulary, encoder

#: BM25's usual constants.
K1, B = 1.2, 0.75


def _encode(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """(doc_id, ids, key, terms) for each document, terms (distinct ids, then their counts) where a full window leaves a rest;
    one row a task with statistics."""

    def run(batches):
        encode = encoder(vocabulary)
        orders = np.random.default_rng(7).permuted(np.tile(np.arange(encode.size, dtype=np.int32), (3, 1)), axis=1)
        frequency, count, length = np.zeros(encode.size, np.int64), 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("key", pa.int64()), ("terms", pa.binary()), ("stats", pa.binary())])
        for batch in batches:
            bodies, keys, terms = [], [], []
            flat, bounds = encode.batch(batch[1], end_id)
            count, length = count + len(batch), length + len(flat)
            for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = flat[at:to]
                ordered = np.sort(ids, kind="stable")  # by radix where an id has 16 bits
                first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
                distinct = ordered[first]
                frequency[distinct] += 1
                own = distinct[distinct != end_id]
                a, b, c = (int(order.take(own).min()) for order in orders) if len(own) else (0, 0, 0)
                keys.append((a << 40) | (b << 20) | c)
                bodies.append(ids.tobytes())
                split = len(ids) > window and len(ids) % window
                terms.append(distinct.tobytes() + np.diff(first, append=len(ids)).astype("<u4").tobytes() if split else None)
            yield pa.RecordBatch.from_arrays(
                [batch[0].cast(pa.int64()), pa.array(bodies, pa.binary()), pa.array(keys, pa.int64()), pa.array(terms, pa.binary()), pa.nulls(len(keys), pa.binary())], schema=schema
            )
        if count:
            stats = np.concatenate([[count, length], frequency]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(stats, 1)], pa.binary())], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(chosen.mapInArrow(run, "doc_id long, ids binary, key long, terms binary, stats binary"))


def _statistics(encoded: DataFrame) -> np.ndarray:
    """[documents, ids, document frequency of each id], over the whole corpus; at most 16 vectors reach the driver."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch[0].to_pylist():
                own = np.frombuffer(zlib.decompress(x), "<i8")
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"stats": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = encoded.where("stats is not null").select("stats").repartition(16).mapInArrow(add, "stats binary").collect()
    return sum((np.frombuffer(zlib.decompress(r.stats), "<i8") for r in rows), np.zeros(1, np.int64))


def _pieces(arrays: list[np.ndarray], weights: np.ndarray, mean: float, window: int, wholes: dict[int, tuple] | None = None):
    """Pack one shard: yields lists of (document, start, length), one list a window.

    wholes: for the arrays that are rests, their document's (length, distinct ids, counts); they are scored by these.
    """
    n, wholes = len(arrays), wholes or {}
    sizes = np.array([len(a) for a in arrays], np.int64)
    lengths = sizes.copy()
    plain = np.ones(n, bool)
    for i, (total, _, _) in wholes.items():
        lengths[i], plain[i] = total, False
    flat = np.concatenate([np.zeros(0, np.int64), *(a for a, p in zip(arrays, plain, strict=True) if p)])
    pairs, tf = np.unique(flat * n + np.repeat(np.flatnonzero(plain), sizes[plain]), return_counts=True)
    if wholes:
        pairs = np.concatenate([pairs, *(ids.astype(np.int64) * n + i for i, (_, ids, _) in wholes.items())])
        tf = np.concatenate([tf, *(counts for _, _, counts in wholes.values())])
        order = np.argsort(pairs, kind="stable")
        pairs, tf = pairs[order], tf[order]
    term, doc = pairs // n, (pairs % n).astype(np.int64)
    weight = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
    some = weight > 0
    term, doc, weight = term[some], doc[some], weight[some]
    posted, first = np.unique(term, return_index=True)
    first = np.append(first, len(term))
    by_doc = np.argsort(doc, kind="stable")
    doc_first = np.searchsorted(doc[by_doc], np.arange(n + 1))
    slot = np.searchsorted(posted, term)

    def neighbours(seed: int):
        """Documents with a positive score, best first, ties in key order."""
        own = slot[by_doc[doc_first[seed] : doc_first[seed + 1]]]
        if len(own):
            spans = [(first[s], first[s + 1]) for s in own.tolist()]
            scores = np.bincount(np.concatenate([doc[a:b] for a, b in spans]), np.concatenate([weight[a:b] for a, b in spans]), n)
            scores[used] = 0
            if n > 64:
                top = np.argpartition(-scores, 63)[:64]
                top = top[np.lexsort((top, -scores[top]))]
                yield from top[scores[top] > 0].tolist()
            order = np.argsort(-scores, kind="stable")
            yield from order[scores[order] > 0].tolist()

    used, cursor, left, at = np.zeros(n, bool), 0, -1, 0
    while True:
        if left < 0:
            while cursor < n and used[cursor]:
                cursor += 1
            if cursor == n:
                return
            left, at = cursor, 0
            used[cursor] = True
        seed, room, found = left, window, []
        near = None
        while True:
            take = min(room, int(sizes[left]) - at)
            found.append((left, at, take))
            room, at = room - take, at + take
            if at == sizes[left]:
                left = -1
            if not room:
                break
            near = neighbours(seed) if near is None else near
            left = next((x for x in near if not used[x]), -1)
            if left < 0:
                while cursor < n and used[cursor]:
                    cursor += 1
                if cursor == n:
                    break
                left = cursor
            used[left], at = True, 0
        yield found
        if left < 0 and used.all():
            return


def _powers(pieces: list[tuple[int, int, int]], window: int):
    """Cut a window that is not full into windows whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    if total == window:
        yield pieces
        return
    queue = list(pieces)[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, out = 1 << bit, []
            while room:
                doc, start, length = queue.pop()
                take = min(room, length)
                out.append((doc, start, take))
                room -= take
                if take < length:
                    queue.append((doc, start + take, length - take))
            yield out


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Set in the sequence ids of windows that one document fills alone.
ALONE = 1 << 62


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _piece(doc_id, ids: np.ndarray, start: int, total: int, sequence: int, offset: int) -> tuple:
    raw = ids.astype("<u4").tobytes()
    return doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, vocabulary: str | None = None, shard_tokens: int = 1_000_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (bytes)."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or default_vocabulary()
    encoded = _encode(docs, vocabulary, end_id, window)
    totals = _statistics(encoded)
    if len(totals) == 1:
        totals = np.zeros(3, np.int64)
    documents, length, frequency = int(totals[0]), int(totals[1]), totals[2:]
    weights = np.maximum(0, np.log((documents - frequency + 0.5) / (frequency + 0.5))) * (frequency > 0)
    mean = length / max(documents, 1)
    width = 2 if len(frequency) <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    shared = spark.sparkContext.broadcast(weights)  # one number an id of the vocabulary

    def alone(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = np.frombuffer(body, kind)
                for start in range(0, len(ids) - window + 1, window):
                    rows.append(_piece(doc_id, ids[start : start + window], start, len(ids), ALONE | (part << 36) | number, 0))
                    number += 1
                    if len(rows) >= 2000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    def together(batches):
        part, number = TaskContext.get().partitionId(), 0
        names, arrays, wholes, size, postings = [], [], {}, 0, 0

        def flush():
            nonlocal names, arrays, wholes, size, postings, number
            rows = []
            for full in _pieces(arrays, shared.value, mean, window, wholes):
                for pieces in _powers(full, window):
                    offset = 0
                    for doc, start, count in pieces:
                        doc_id, total, before = names[doc]
                        rows.append(_piece(doc_id, arrays[doc][start : start + count], before + start, total, (part << 36) | number, offset))
                        offset += count
                    number += 1
                    if len(rows) >= 2000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)
            names, arrays, wholes, size, postings = [], [], {}, 0, 0

        for batch in batches:
            for doc_id, total, rest, terms in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                arrays.append(np.frombuffer(rest, kind))
                names.append((doc_id, total, total - len(arrays[-1])))
                size += len(arrays[-1])
                if terms is None:
                    postings += len(arrays[-1])
                else:
                    distinct = len(terms) // (width + 4)
                    wholes[len(arrays) - 1] = total, np.frombuffer(terms, kind, distinct), np.frombuffer(terms, "<u4", distinct, distinct * width)
                    postings += distinct
                if max(size, postings) >= shard_tokens:
                    yield from flush()
        if names:
            yield from flush()

    whole = encoded.where("ids is not null").withColumn("total", F.octet_length("ids") / F.lit(width))
    whole = whole.withColumn("total", F.col("total").cast("long"))
    long_ones = whole.where(F.col("total") >= window).select("doc_id", "ids").mapInArrow(alone, COLUMNS)
    left = (F.col("total") % window).cast("int")
    rests = whole.where(left > 0).select(
        "doc_id", "total", F.substring(F.col("ids"), ((F.col("total") - left) * width + 1).cast("int"), left * width).alias("rest"), "terms", "key", F.xxhash64("doc_id").alias("salt"), F.monotonically_increasing_id().alias("copy")
    )
    # rows of one text and one doc_id (or none) share key and salt: their number in the written table spreads them
    shards = rests.repartitionByRange(partitions(spark), "key", "salt", "copy").sortWithinPartitions("key", "salt", "copy")
    return shards.select("doc_id", "total", "rest", "terms").mapInArrow(together, COLUMNS).union(long_ones)


def op2_lexical_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed to 2048: one row a piece, without the ids themselves."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
