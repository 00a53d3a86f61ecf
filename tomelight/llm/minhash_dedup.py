"""MinHash near-dedup by a signature-coordinate inverted join (operator 3).

1. A text's set is its distinct 5-word shingles (64-bit hashes). Texts with equal sets form one class at once; only
   classes go on, so any number of copies costs one row.
2. A class's signature has ``COORDINATES`` min-hash values. The inverted index posts a class under each
   (coordinate, value). Two classes with Jaccard similarity 0.75 agree on 48 of 64 coordinates on average; pairs that
   agree on at least ``MATCHES`` = 30 are retained (a pair at exactly 0.75 falls short with probability 3e-7).
3. Prefix: values that one class alone has can't collide and are dropped; classes with fewer than MATCHES shared values
   are done. The others order their values by rising frequency, and post only as many of the rarest as guarantee that
   two classes with MATCHES common values meet in one list; so frequent values (a passage that many texts carry)
   stay out of the lists unless a text is made of them.
4. Lists give candidates in rounds that never pair a group with itself. In the first, each class meets the most typical
   class of its lists (the one whose values are the most frequent, usually the text that the others were copied from); in
   the second, classes outside a list's largest component meet the most typical one among them. A class has one pair
   a round. Collisions are counted over whole signatures, pairs below MATCHES are skipped, the rest is confirmed on the
   full sets, and links join components; lists within one component are finished.
5. What is left is exact: in lists that still span components, the classes outside the largest one meet all others. They
   do so in blocks: classes are dealt to blocks of at most about BLOCK_CLASSES like ones, a set travels once for each
   pair of blocks that a list connects, and one task counts, skips and confirms inside a pair of blocks; it returns
   links that join components and no other pairs.

Defined results: null or blank texts have an empty set, stay alone and are kept; fewer than five words are one
shingle; repeated rows share the component of their text; a row with a null doc_id never is the smallest of its
component unless no row of it has an id (then component_id is null and all its rows are kept; the stage that drops copies keeps one of
them); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, fresh, materialize, small_batches, text_or_empty, without_caches
from ._words import shingle_sets, text_slices, word_hashes

WIDTH, PERCENT = 5, 75
COORDINATES, MATCHES = 64, 30
BLOCK_CLASSES = 512

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_TERMS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit min-hash values a set (none of them empty)."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat * _FACTORS[k] + _TERMS[k]) >> np.uint64(32), first)
    return out


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, fp (128-bit hash of the set), values (the signature)."""

    def run(batches):
        without_caches()
        for batch in batches:
            for at, raw, offsets in text_slices(batch[1]):
                sets = shingle_sets(*word_hashes(raw, offsets), WIDTH)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                values = [None] * len(sets)
                if len(some):
                    found = signature([sets[i] for i in some.tolist()])
                    for i, row in zip(some.tolist(), found, strict=True):
                        values[i] = row.tobytes()
                prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                rows = slice(at, at + len(sets))
                yield pa.RecordBatch.from_arrays([batch[0][rows], batch[2][rows], pa.array(sizes), pa.array(prints, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "h", "n_shingles", "fp", "signature"])

    text = text_or_empty()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return materialize(chosen.mapInArrow(run, "doc_id long, h long, n_shingles long, fp binary, signature binary"))


def _posted(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, token) for the prefix of each class (its rarest values that another class shares), and (cid, weight)."""

    def explode(batches):
        coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch[1].to_pylist()), np.uint32).reshape(-1, COORDINATES)
            tokens = pa.array((values.astype(np.int64) | coordinate).ravel())
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(np.repeat(np.arange(len(values)), COORDINATES))), tokens], ["cid", "token"])

    tokens = classes.select("cid", "signature").mapInArrow(explode, "cid long, token long")
    frequent = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = tokens.join(frequent, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    # at most COORDINATES values a class; two classes with MATCHES common ones meet in the first n - MATCHES + 1
    prefix = F.slice("found", 1, F.greatest(F.lit(0), F.size("found") - MATCHES + 1))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x.df)
    kept = materialize(shared.where(F.size("found") >= MATCHES).select("cid", weight.alias("weight"), F.transform(prefix, lambda x: x.token).alias("tokens")))
    return kept.select("cid", F.explode("tokens").alias("token")), kept.select("cid", "weight")


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common values of every row of x with every row of y, a coordinate at a time."""
    total = np.zeros((len(x), len(y)), np.uint8)
    for k in range(COORDINATES):
        total += x[:, k, None] == y[None, :, k]
    return total


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have PERCENT or more of their union in common."""
    low, high = sorted((len(x), len(y)))
    if 100 * low < PERCENT * high:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


class _Index:
    """Postings, signatures and sets of the classes that share enough values with others."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.posts, self.weights = _posted(classes)
        need = classes.join(self.weights.select("cid"), "cid", "left_semi").select("cid", "signature", F.col("doc_id").alias("d"), F.col("h").alias("th"))
        text = text_or_empty()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))

        def sets(batches):
            without_caches()
            for batch in batches:
                for at, raw, offsets in text_slices(batch[2]):
                    found = [s.tobytes() for s in shingle_sets(*word_hashes(raw, offsets), WIDTH)]
                    rows = slice(at, at + len(found))
                    yield pa.RecordBatch.from_arrays([batch[0][rows], batch[1][rows], pa.array(found, pa.binary())], ["cid", "signature", "shingles"])

        rows = need.join(texts, need["d"].eqNullSafe(texts["doc_id"]) & (need["th"] == texts["h"])).select("cid", "signature", "text")
        self.sets = materialize(rows.mapInArrow(sets, "cid long, signature binary, shingles binary"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b): those whose signatures and sets agree. A class is in one pair as a, so sets travel once a pair."""

        def check(batches):
            for batch in batches:
                rows = zip(*[batch[i].to_pylist() for i in range(2, 6)], strict=True)
                kept = [
                    int((np.frombuffer(sa, np.uint32) == np.frombuffer(sb, np.uint32)).sum()) >= MATCHES and _similar(np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64))
                    for sa, sb, xa, xb in rows
                ]
                yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(kept, pa.bool_()))

        s = self.sets
        left = pairs.join(s.select(F.col("cid").alias("a"), F.col("signature").alias("sa"), F.col("shingles").alias("xa")), "a")
        both = left.join(s.select(F.col("cid").alias("b"), F.col("signature").alias("sb"), F.col("shingles").alias("xb")), "b")
        return materialize(both.select("a", "b", "sa", "sb", "xa", "xb").mapInArrow(check, "a long, b long"))

    def across(self, open_: DataFrame, minor: DataFrame) -> DataFrame:
        """Links between components: minor classes (token, cid, component) against all open ones, in pairs of blocks."""
        homes = self.posts.groupBy("token").agg(F.min("cid").alias("home"))
        home = materialize(open_.select("token", "cid").join(homes, "token").groupBy("cid").agg(F.min("home").alias("home")))

        def dealt(rows: DataFrame) -> DataFrame:
            members = rows.select("cid").distinct().join(home, "cid")
            sizes = members.groupBy("home").agg(F.count("*").alias("n"))
            block = F.xxhash64("home", F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / BLOCK_CLASSES)))
            return materialize(members.join(sizes, "home").select("cid", block.alias("block")))

        left, right = dealt(minor), dealt(open_)
        lists_left = minor.join(left, "cid").select("token", F.col("block").alias("p")).distinct()
        lists_right = open_.join(right, "cid").select("token", F.col("block").alias("q")).distinct()
        met = materialize(lists_left.join(lists_right, "token").select("p", "q").distinct())
        component = open_.select("cid", "component").distinct()
        known = self.sets.join(component, "cid")
        x = met.join(left, met["p"] == left["block"]).select("p", "q", "cid").join(known, "cid").select("p", "q", "cid", "component", "signature", "shingles")
        y = met.join(right, met["q"] == right["block"]).select("p", "q", "cid").join(known, "cid").select(F.col("p").alias("r"), F.col("q").alias("s"), F.col("cid").alias("c"), F.col("component").alias("k"), F.col("signature").alias("g"), F.col("shingles").alias("x"))

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            def unpack(t):
                _, _, cid, component, signatures, shingles = (t.column(i).to_pylist() for i in range(6))
                own = np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, COORDINATES)
                return cid, component, own, [np.frombuffer(s, np.uint64) for s in shingles]

            without_caches()
            out, top = [], {}

            def root(c):
                while c in top:
                    c = top[c]
                return c

            if a.num_rows and b.num_rows:
                ids, parts, own, sets = unpack(a)
                ids2, parts2, own2, sets2 = unpack(b)
                for at in range(0, len(ids), 64):
                    rows, columns = np.nonzero(_matches(own[at : at + 64], own2) >= MATCHES)
                    for i, j in zip((rows + at).tolist(), columns.tolist(), strict=True):
                        c, d = root(parts[i]), root(parts2[j])
                        if c != d and _similar(sets[i], sets2[j]):
                            out.append((ids[i], ids2[j]))
                            top[max(c, d)] = min(c, d)
            return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

        return materialize(x.groupBy("p", "q").cogroup(y.groupBy("r", "s")).applyInArrow(compare, "a long, b long"))


def _components(index: _Index) -> DataFrame:
    """(cid, component) of every class that posted."""
    spark = index.posts.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = index.weights.select("cid", F.col("cid").alias("component"), "weight")
    for last in (False, False, True):
        posted = index.posts.join(labels, "cid")
        spans = posted.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
        open_ = materialize(posted.join(spans, "token"))
        if open_.isEmpty():
            break
        sizes = open_.groupBy("token", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"))
        first = links.isEmpty()  # every class is still alone
        minor = open_.join(largest, "token").where(F.lit(first) | (F.col("component") != F.col("largest"))).select("token", "cid", "component", "weight")
        if last:
            new = index.across(open_, minor.drop("weight"))
        else:
            hub = F.max_by(F.struct("weight", "cid", "component"), F.struct("weight", "cid")).alias("hub")
            met = minor.join(minor.groupBy("token").agg(hub), "token").where("hub.component <> component")
            pairs = met.groupBy("cid").agg(F.max_by(F.col("hub.cid"), F.struct("hub.weight", "hub.cid")).alias("b"))
            new = index.confirmed(pairs.select(F.col("cid").alias("a"), "b"))
        links = links.union(new)
        joined = connected_components(links)
        labels = index.weights.join(joined, index.weights["cid"] == joined["id"], "left").select("cid", F.coalesce("component", "cid").alias("component"), "weight")
        labels = materialize(labels)
    return labels


def _judged(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, h (hash of the text), n_shingles, component (null: no set), component_id, kept."""
    small_batches(docs.sparkSession)
    rows = _sketch(docs)
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min_by(F.struct("doc_id", "h", "signature"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x"))
    classes = materialize(classes.select("fp", "x.doc_id", "x.h", "x.signature", F.monotonically_increasing_id().alias("cid")))
    index = _Index(docs, classes)
    if index.weights.isEmpty():
        found = classes.select("fp", F.col("cid").alias("component"), F.col("doc_id").alias("component_id"))
    else:
        labels = _components(index)
        whole = classes.join(labels, "cid", "left").select("fp", "doc_id", F.coalesce("component", "cid").alias("component"))
        least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        found = materialize(whole.join(least, "component").select("fp", "component", "component_id"))
    linked = rows.select("doc_id", "h", "n_shingles", "fp").join(found, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return linked.select("doc_id", "h", "n_shingles", "component", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept."""
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, and all rows without a set, as they are.

    Of a component the row that ``near_duplicates`` keeps stays. Where several are kept (a repeated doc_id, or none of the component has
    one), it is the one whose text has the least hash, and one row of those with that id and text. Rows are told by id and text
    and not by id alone, so a row that shares its id with a copy stays.
    """
    judged = materialize(_judged(docs).where("component is not null"))
    stays = judged.where("kept").groupBy("component").agg(F.min("h").alias("h")).withColumn("stays", F.lit(True))
    keys = judged.groupBy("component", "doc_id", "h", "kept").agg(F.count("*").alias("n")).join(stays, ["component", "h"], "left")
    keys = materialize(keys.select("doc_id", "h", (F.col("kept") & F.col("stays").isNotNull()).alias("stays"), "n"))
    out_id, out_h = fresh(docs, "gone_id", "gone_h")

    def matched(rows: DataFrame, kind: str, wanted: DataFrame) -> DataFrame:
        named = wanted.select(F.col("doc_id").alias(out_id), F.col("h").alias(out_h))
        return rows.join(named, rows["doc_id"].cast("long").eqNullSafe(named[out_id]) & (F.xxhash64(text_or_empty()) == named[out_h]), kind)

    repeated = keys.where("stays and n > 1")
    gone = keys.where(~F.col("stays"))
    if repeated.isEmpty():
        return matched(docs, "left_anti", gone)
    rest = matched(docs, "left_anti", gone.union(repeated))
    return rest.unionByName(matched(docs, "left_semi", repeated).dropDuplicates(["doc_id", "text"]))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the same rows on small tables: every pair that shares a shingle, and links followed to their end (doc_id is unique).
ORACLE_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, a AS x FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x),
k AS (SELECT a AS doc_id, min(x) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id, coalesce(k.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
