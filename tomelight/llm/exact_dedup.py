"""Exact dedup by deterministic block naming, DataFrame functions only (operator 6).

Texts lose their white space and are cut into blocks of a fixed number of characters. Level 0 names blocks: equal
blocks get one integer, different blocks never share one. Each later level names adjacent pairs of names the same
way, so a text of k blocks has one name after ceil(log2 k) levels, and two texts are equal exactly when their
numbers of blocks and last names are (the doubling of Karp, Miller and Rosenberg).

How names are given: the distinct blocks are grouped (each task first combines its own copies, so a group that holds
a third of all rows arrives as one row a task), sorted, and numbered as they are written to the shared folder. A
row finds its name by the block's 64-bit hash. That is collision-free, not just likely so: the named table shows
which hashes stand for two different blocks, and rows with those hashes join by the block itself. Pairs of names
are joined as they are. The rows' side of a join is never grouped, so skewed joins are split by adaptive execution.

Defined results: a null text counts as empty, and all empty texts are one group; repeated rows (same doc_id, same
text) are rows of their own, of which one is kept; a null doc_id sorts after all others in ties; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import every, fresh, materialize, text_or_empty

#: The characters that normalisation deletes: [\x20\x09-\x0D].
BLANKS = (" ", "\n", "\t", "\r", "\x0b", "\x0c")


def without_space(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of keys with an integer ``name`` each, fixed by writing them."""
    distinct = rows.select(*keys).groupBy(*keys).count().drop("count").sortWithinPartitions(*keys)
    return materialize(distinct.withColumn("name", F.monotonically_increasing_id()))


def _name_blocks(rows: DataFrame) -> DataFrame:
    """(rid, pos, blocks, name) of rows (rid, pos, blocks, block)."""
    distinct = rows.select("block").groupBy("block").count().drop("count").sortWithinPartitions("block")
    names = materialize(distinct.select("block", F.xxhash64("block").alias("h"), F.monotonically_increasing_id().alias("name")))
    hashed = rows.select("rid", "pos", "blocks", F.xxhash64("block").alias("h"), "block")
    shared = materialize(names.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return hashed.drop("block").join(names.select("h", "name"), "h").select("rid", "pos", "blocks", "name")
    single = names.join(shared, "h", "left_anti").select("h", "name")
    plain = hashed.drop("block").join(single, "h").select("rid", "pos", "blocks", "name")
    exact = hashed.join(shared, "h").join(names.select("block", "name"), "block").select("rid", "pos", "blocks", "name")
    return plain.union(exact)


def identities(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """One row a row of docs: rid, doc_id, points (code points of the text), sha256, blocks, identity.

    Rows are equal in normalised text exactly when (blocks, identity) are equal. A text is cut in one pass over it.
    """
    text = text_or_empty()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("points"), without_space(text).alias("plain"))
    cut = F.regexp_extract_all(F.col("plain"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    base = base.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "points", F.sha2(F.col("plain").cast("binary"), 256).alias("sha256"), F.when(F.col("plain") == "", F.array(F.lit(""))).otherwise(cut).alias("cut")
    )
    blocks = base.select("rid", "doc_id", "points", "sha256", F.size("cut").alias("blocks"), F.posexplode("cut").alias("pos", "block"))
    first = F.col("pos") == 0
    # what describes the row stays with its first block
    rows = materialize(
        blocks.select("rid", "pos", "blocks", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("points")).alias("points"), F.when(first, F.col("sha256")).alias("sha256"), "block")
    )
    heads = rows.where("pos = 0").select("rid", "doc_id", "points", "sha256", "blocks")
    current = materialize(_name_blocks(rows.select("rid", "pos", "blocks", "block")))
    longest = rows.agg(F.max("blocks")).first()[0] or 1
    finished = current.where("blocks = 1")
    while longest > 1:
        # only texts that still have more than one name go on; the one name of the others is their identity
        half, fewer = F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")
        even = F.col("pos") % 2 == 0
        sides = F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")
        pairs = materialize(current.where("blocks > 1").groupBy("rid", half, fewer).agg(*sides))
        current = materialize(pairs.join(_named(pairs, ["l", "r"]), ["l", "r"]).select("rid", "pos", "blocks", "name"))
        finished = finished.union(current.where("blocks = 1"))
        longest = -(-longest // 2)
    return heads.join(finished.select("rid", F.col("name").alias("identity")), "rid")


def exact_dedup(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256, and rid, points.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    named = materialize(identities(docs, block_chars))
    falling = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(-(2**63)))
    order = F.struct(F.col("points"), falling.alias("o"), (-F.col("rid")).alias("r"))
    groups = named.groupBy("blocks", "identity").agg(
        F.max_by(F.struct("doc_id", "rid"), order).alias("best"), F.count("*").alias("group_size")
    )
    # a group's row is needed only where there is more than one row; the join's large side is not grouped
    groups = materialize(groups.select("blocks", "identity", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("best_rid"), "group_size"))
    joined = named.join(groups, ["blocks", "identity"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best_rid")).alias("kept"), F.col("sha256").alias("text_sha256"), "rid", "points")


def drop_exact_copies(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """docs with the row of each group that stays, as it is; of rows that agree in doc_id, normalised text and length, the one
    with the least text stays."""
    kept = exact_dedup(docs, block_chars).where("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s"), F.col("points").alias("p"))
    text = text_or_empty()
    own = fresh(docs, "k", "s", "p", "own_id", "own_sha", "own_points", "row")[3:]
    digest = F.sha2(without_space(text).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias(own[0]), digest.alias(own[1]), F.length(text).cast("long").alias(own[2]), F.struct(*every(docs)).alias(own[3]))
    same = rows[own[0]].eqNullSafe(kept["k"]) & (rows[own[1]] == kept["s"]) & (rows[own[2]] == kept["p"])
    joined = rows.join(kept, same, "left_semi")
    # the text travels once, inside its row
    return joined.groupBy(*own[:3]).agg(F.min_by(own[3], text_or_empty(f"{own[3]}.text")).alias("stays")).select("stays.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "points")


#: DuckDB SQL for the same rows (doc_id is unique in the tables).
ORACLE_OP6 = r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM base
WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id)
"""
