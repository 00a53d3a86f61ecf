"""Embedding near-dedup by collision-counting projections (operator 10).

Equal vectors form one class, by a digest of their bytes (negative zeros folded first); only classes go on.

1. Tables. Every class is projected on many random lines. A table takes a few of the lines and files a class under the
   sides of zero on which it lies there, so a cell of a table holds about ``cell`` classes at any size of the corpus. The number of
   tables is calibrated (``tables_for``): a pair at exactly the threshold shares a cell of some table with a set probability,
   for whatever data, as the chance depends on the pair's angle only. It grows with about the fifth root of the rows.
2. Counting. In a cell, the classes are sorted on one line, and each looks at the window of half-width ``h`` around itself.
   Collisions in the windows of the other lines, centred at the same class, are counted for each pair; a pair passes with
   ``least`` of them or more. Widths and count are calibrated for pairs at the threshold (``calibrate``).
3. Pairs that pass are verified by their cosine in double precision. A pair that meets in several tables is counted in the
   first of them, which the sides of its two classes tell.

A cell returns for each class its number of links and one tie to its part of the cell, so rows are bounded by classes and
tables and not by pairs. Two things keep dense groups from being compared with themselves:

* Cores. A sample of ``SAMPLE`` classes (a bound, spent on finding hubs only) shows groups that hold a share of the corpus. Every class
  whose angle with its nearest hub is at most half the threshold's angle is in the hub's core; any two of a core are linked
  by the triangle inequality, so a core's links are a sum and its pairs are never visited. This is exact.
* Parts. What else overfills a cell is dealt to parts of at most about ``block`` classes, and pairs of parts meet in groups of
  their own, but never two parts of one core.

Recall at exactly 0.9 is calibrated to ``recall`` and rises quickly above (see tests and README for measurements).

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their
own component; vectors of different length are never linked; 0.0 and -0.0 are the same; repeated vectors link with each other;
rows with equal vec_id are rows of their own; a row with a null vec_id never is the smallest of its component; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import connected_components, materialize, small_batches

#: Lines whose windows are counted, and lines whose sides file a class in tables.
COUNTED, SIDES = 16, 256
#: Classes that are looked at for hubs, and how many of them must be near one for it to be a hub.
SAMPLE, HUB_LEAST = 2048, 8
#: Found pairs that are verified at once.
CHUNK = 1 << 15


@lru_cache
def lines(dimension: int, count: int = COUNTED + SIDES) -> np.ndarray:
    """Random unit vectors, orthonormal as far as the dimension allows."""
    draw = np.random.default_rng(5)
    parts = [np.linalg.qr(draw.standard_normal((dimension, dimension)))[0] for _ in range(-(-count // dimension))]
    return np.concatenate(parts, axis=1)[:, :count]


@lru_cache
def calibrate(dimension: int, threshold: float, recall: float, samples: int = 200_000) -> tuple[float, float, int]:
    """(half-width on the sorted line, half-width on the others, least count of the others) for pairs at the threshold.

    Every pair must collide on the sorted line, so its window misses half of what ``recall`` allows; the others miss 1 % each,
    and the count keeps ``recall`` of both together.
    """
    draws = np.random.default_rng(3).standard_normal((samples, min(dimension, 8)))
    rest = np.random.default_rng(4).chisquare(dimension - 8, samples) if dimension > 8 else 0
    along = np.abs(draws[:, 0]) / np.sqrt((draws**2).sum(1) + rest)
    distance = np.sqrt(max(0.0, 2 - 2 * threshold))
    hit, first_hit, others = 0.99, 1 - (1 - recall) / 2, COUNTED - 1
    tail, chance, least = 0.0, 0.99**others, others + 1
    while least > 0 and first_hit * tail < recall:
        least -= 1
        tail += chance
        chance *= least / (others - least + 1) * (1 - hit) / hit
    return float(distance * np.quantile(along, first_hit)), float(distance * np.quantile(along, hit)), least


def _pair_sides(dimension: int, threshold: float, samples: int) -> np.ndarray:
    """For random pairs at the threshold: on which of the lines they lie on different sides."""
    draw = np.random.default_rng(8)
    a = draw.standard_normal((samples, dimension))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.standard_normal((samples, dimension))
    b -= (a * b).sum(1)[:, None] * a
    norm = np.linalg.norm(b, axis=1)[:, None]
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.where(norm > 1e-9, norm, 1)
    sides = lines(dimension)[:, COUNTED:]
    return (a @ sides >= 0) != (b @ sides >= 0)


@lru_cache
def tables_for(dimension: int, threshold: float, bits: int, recall: float, samples: int = 20_000) -> np.ndarray:
    """The lines of each table, one row a table: as many as give ``recall`` of random pairs at the threshold a common cell."""
    if not bits:
        return np.zeros((1, 0), np.int64)
    differ, draw = _pair_sides(dimension, threshold, samples), np.random.default_rng(9)
    met, chosen = np.zeros(samples, bool), []
    while met.mean() < recall:
        chosen.append(np.sort(draw.choice(SIDES, bits, replace=False)))
        met |= ~differ[:, chosen[-1]].any(1)
    return np.array(chosen)


def _units(vectors: list[bytes], kind) -> np.ndarray:
    """Rows of unit length in double precision, of equal dimension."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dimension(column: pa.Array):
    """(dimension, places) of a batch's dimension column."""
    found = column.to_numpy()
    for d in np.unique(found).tolist():
        yield d, np.flatnonzero(found == d)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


class Search:
    """What tasks need to know: the threshold, and each dimension's tables and windows."""

    def __init__(self, threshold: float, recall: float, bits: dict[int, int], kind):
        self.threshold, self.kind = threshold, kind
        self.windows = {d: calibrate(d, threshold, 1 - (1 - recall) / 4) for d in bits}
        self.tables = {d: tables_for(d, threshold, k, 1 - (1 - recall) * 3 / 4) for d, k in bits.items()}

    def near(self, d: int, x: np.ndarray, sides: np.ndarray, core: np.ndarray, side: np.ndarray, table: int):
        """Linked pairs (i, j) of a group that no earlier table has found; between the two sides, or inside one."""
        wide, half, least = self.windows[d]
        # one byte a projection: differences are taken modulo 256, so far values may seem near but near ones are never lost
        scale = 128.0
        marks = np.round(x @ lines(d)[:, :COUNTED] * scale).astype(np.int64).astype(np.uint8).T.copy()
        first = x @ lines(d)[:, 0]
        wide_by, half_by = int(np.ceil(wide * scale)) + 1, int(np.ceil(half * scale)) + 1
        alone = not side.any()
        left = np.flatnonzero(side == 0)
        left = left[np.argsort(first[left], kind="stable")]
        right = left if alone else np.flatnonzero(side == 1)
        right = right[np.argsort(first[right], kind="stable")]
        row, ours, theirs = first[right], marks[:, left], marks[:, right]
        tables = self.tables[d]
        for at in range(0, len(left), 128):
            tile = left[at : at + 128]
            low, high = np.searchsorted(row, [first[tile[0]] - wide, first[tile[-1]] + wide])
            if alone:
                low = max(low, at + 1)
            if low >= high:
                continue
            count = np.zeros((len(tile), high - low), np.uint8)
            for m in range(1, COUNTED):
                if 2 * half_by >= 255:
                    count += 1
                else:
                    count += (theirs[m, None, low:high] - (ours[m, at : at + 128, None] - np.uint8(half_by))) <= np.uint8(2 * half_by)
            good = count >= least
            if 2 * wide_by < 255:
                good &= (theirs[0, None, low:high] - (ours[0, at : at + 128, None] - np.uint8(wide_by))) <= np.uint8(2 * wide_by)
            i, j = np.nonzero(good)
            j = j + low
            if alone:
                later = j > i + at
                i, j = i[later], j[later]
            i, j = tile[i], right[j]
            apart = (core[i] < 0) | (core[i] != core[j])
            i, j = i[apart], j[apart]
            for part in range(0, len(i), CHUNK):
                a, b = i[part : part + CHUNK], j[part : part + CHUNK]
                linked = np.einsum("ij,ij->i", x[a], x[b]) >= self.threshold
                a, b = a[linked], b[linked]
                if table and len(a):
                    differ, new = sides[a] != sides[b], np.ones(len(a), bool)
                    for earlier in tables[:table]:
                        some = np.flatnonzero(new)
                        new[some] = differ[np.ix_(some, earlier)].any(1)
                    a, b = a[new], b[new]
                if len(a):
                    yield a, b


def _prepared(vectors: DataFrame, kind) -> DataFrame:
    """vec_id, fp (digest of the vector, null if it links with nothing), vector (bytes), dimension."""

    def run(batches):
        for batch in batches:
            column = batch[1]
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            a, b = offsets[:-1], offsets[1:]
            sound = column.is_valid().to_numpy(zero_copy_only=False) & (bad[b] == bad[a]) & (some[b] > some[a])
            raw, width = values.tobytes(), values.itemsize
            found = [raw[x * width : y * width] if ok else None for x, y, ok in zip(a.tolist(), b.tolist(), sound.tolist(), strict=True)]
            prints = [None if v is None else xxhash.xxh3_128_digest(v) for v in found]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(prints, pa.binary()), pa.array(found, pa.binary()), pa.array(b - a)], ["vec_id", "fp", "vector", "dimension"])

    return materialize(vectors.mapInArrow(run, "vec_id long, fp binary, vector binary, dimension long"))


def _hubs(classes: DataFrame, threshold: float, kind) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (cids, unit vectors) of hubs: sampled classes with many sampled ones within half the threshold's angle."""
    widest = classes.agg(F.max("dimension")).first()[0] or 1
    most = max(64, min(SAMPLE, (32 << 20) // (8 * widest)))
    rows = classes.select("cid", "dimension", "vector").orderBy(F.xxhash64(F.lit("hub"), "cid"), "cid").limit(most).collect()
    inside, found = np.cos(np.arccos(threshold) / 2) + 1e-9, {}
    for d in {r.dimension for r in rows}:
        own = [r for r in rows if r.dimension == d]
        x = _units([r.vector for r in own], kind)
        close, open_, chosen = x @ x.T >= inside, np.ones(len(own), bool), []
        while True:
            counts = (close & open_[None, :]).sum(1) * open_
            best = int(counts.argmax())
            if counts[best] < HUB_LEAST:
                break
            chosen.append(best)
            open_ &= ~close[best]
        if chosen:
            found[d] = np.array([own[i].cid for i in chosen], np.int64), x[chosen]
    return found


def near_vectors(table: DataFrame, threshold: float = 0.9, recall: float = 0.995, cell: int = 1024, block: int = 4096) -> DataFrame:
    """One row a row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    small_batches(spark, 4096)
    kind = table.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    kind = np.float32 if single else np.float64
    rows = _prepared(vectors, kind)
    grouped = rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min(F.struct("dimension", "vector")).alias("v"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "fp", "copies", "least", "v.dimension", "v.vector"))
    sizes = dict(classes.groupBy("dimension").count().collect())  # one number a dimension
    bits = {d: max(0, int(np.ceil(np.log2(n / cell)))) for d, n in sizes.items()}
    search = Search(threshold, recall, bits, kind)
    hubs = _hubs(classes, threshold, kind) if sizes else {}
    shared = spark.sparkContext.broadcast((search, hubs))  # fixed sizes: lines of tables, at most SAMPLE / HUB_LEAST hubs
    inside = np.cos(np.arccos(threshold) / 2) + 1e-9

    def sketch(batches):
        search, hubs = shared.value
        for batch in batches:
            sides, core = [b""] * len(batch), np.full(len(batch), -1, np.int64)
            stored = batch[3].to_pylist()
            for d, places in _by_dimension(batch[2]):
                x = _units([stored[i] for i in places.tolist()], search.kind)
                packed = np.packbits(x @ lines(d)[:, COUNTED:] >= 0, axis=1)
                for i, row in zip(places.tolist(), packed, strict=True):
                    sides[i] = row.tobytes()
                if d in hubs:
                    cids, centres = hubs[d]
                    near = x @ centres.T
                    best = near.argmax(1)
                    close = near[np.arange(len(x)), best] >= inside
                    core[places[close]] = cids[best[close]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides, pa.binary()), pa.array(core)], ["cid", "copies", "dimension", "vector", "sides", "core"])

    points = materialize(classes.select("cid", "copies", "dimension", "vector").mapInArrow(sketch, "cid long, copies long, dimension long, vector binary, sides binary, core long"))

    def post(whole: bool):
        names = ["dimension", "t", "key", "core", *(["cid", "copies", "sides", "vector"] if whole else [])]

        def run(batches):
            search, _ = shared.value
            for batch in batches:
                for d, places in _by_dimension(batch.column("dimension")):
                    own = batch.take(pa.array(places))
                    known = np.frombuffer(b"".join(own.column("sides").to_pylist()), np.uint8).reshape(len(places), -1)
                    known = np.unpackbits(known, axis=1)
                    for t, chosen in enumerate(search.tables[d]):
                        key = known[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(len(chosen), dtype=np.int64))
                        columns = [own.column("dimension"), pa.array(np.full(len(places), t, np.int32)), pa.array(key), own.column("core")]
                        yield pa.RecordBatch.from_arrays([*columns, *(own.column(n) for n in names[4:])], names)

        kinds = "dimension long, t int, key long, core long" + (", cid long, copies long, sides binary, vector binary" if whole else "")
        return points.mapInArrow(run, kinds)

    cells = ["dimension", "t", "key"]
    held = post(False).groupBy(*cells, "core").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(16 << 20) / (F.col("dimension") * 8)))).cast("long")
    full = materialize(held.groupBy(*cells).agg(F.sum("n").alias("all")).where(F.col("all") > limit).select(*cells))
    posts, group = post(True), ["dimension", "t", "key", "ca", "ra", "cb", "rb"]
    one = {"ca": F.lit(-1).cast("long"), "ra": F.lit(0).cast("long"), "cb": F.lit(-1).cast("long"), "rb": F.lit(0).cast("long"), "side": F.lit(0)}
    if full.isEmpty():
        dealt = posts.withColumns(one)
    else:
        parts = materialize(held.join(full, cells).select(*cells, "core", F.ceil(F.col("n") / limit).cast("long").alias("parts")))
        each = parts.select(*cells, "core", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("r"))
        a, b = (each.withColumnsRenamed({"core": f"c{s}", "r": f"r{s}"}) for s in "ab")
        met = a.join(b, cells).where("(ca < cb or (ca = cb and ra <= rb)) and (ca <> cb or ca < 0)")
        met = materialize(met)
        spread = posts.join(parts, [*cells, "core"]).withColumn("r", F.pmod(F.xxhash64("cid"), F.col("parts")))
        chosen = [*posts.columns, *group[3:], "side"]
        left = spread.join(met, cells).where("core = ca and r = ra").withColumn("side", F.lit(0)).select(*chosen)
        right = spread.join(met, cells).where("core = cb and r = rb and (ca <> cb or ra <> rb)").withColumn("side", F.lit(1)).select(*chosen)
        dealt = posts.join(full, cells, "left_anti").withColumns(one).select(*chosen).union(left).union(right)

    def compare(group: pa.Table) -> pa.Table:
        search, _ = shared.value
        d, t = group["dimension"][0].as_py(), group["t"][0].as_py()
        x = _units(group["vector"].to_pylist(), search.kind)
        sides = np.unpackbits(np.frombuffer(b"".join(group["sides"].to_pylist()), np.uint8).reshape(len(x), -1), axis=1)
        cid, copies, core, side = (group[n].to_numpy() for n in ("cid", "copies", "core", "side"))
        links, tie = np.zeros(len(x), np.int64), np.arange(len(x))
        for i, j in search.near(d, x, sides, core, side, t):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # ties are kept as they grow, so that memory is bounded by the classes and not by the pairs
            tie = forest(len(x), np.concatenate([i, np.arange(len(x))]), np.concatenate([j, tie]))
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "links": links[some], "tie": cid[tie[some]]})

    ties = materialize(dealt.groupBy(*group).applyInArrow(compare, "cid long, links long, tie long"))
    cored = points.where("core >= 0").select("cid", "core", "copies")
    inner = cored.join(cored.groupBy("core").agg(F.sum("copies").alias("all")), "core").select("cid", (F.col("all") - F.col("copies")).alias("links"), F.col("core").alias("tie"))
    ties = ties.union(inner)
    joined = connected_components(ties.select(F.col("cid").alias("a"), F.col("tie").alias("b")))
    links = ties.groupBy("cid").agg(F.sum("links").alias("links"))
    labelled = classes.select("cid", "fp", "copies", "least").join(joined.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left")
    labelled = labelled.select("fp", "copies", "least", F.coalesce("component", "cid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialize(labelled.join(smallest, "component").select("fp", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id", "fp").join(found, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_projection_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL for the same rows on small tables: all pairs, and links followed to their end (vec_id is unique).
ORACLE_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a, a AS x FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x),
k AS (SELECT a AS vec_id, min(x) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(k.component_id, vec_id) AS component_id, coalesce(k.component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN k USING (vec_id)
"""
