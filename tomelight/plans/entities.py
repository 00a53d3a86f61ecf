"""Duplicates, similarity, recommendations, merges and change detection as named queries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import names, search_key, shared
from ..operators.resolve import capped_per_author, changed_fields, components, consolidated, dot, keepers, merged_by_priority, newest_per, normalised, rating_proximity, replaced, same_key_groups, same_key_links, similarity, staged_duplicates, top_similar
from ..operators.sets import bulk_set, compare, purged, spread, upsert, without_orphans
from .registry import Tables, query


@query("""
WITH g AS (SELECT p_brand, p_size, p_type, min(p_partkey) AS group_id, count(*) AS members FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT p_partkey, group_id FROM part JOIN g USING (p_brand, p_size, p_type)
""")
def duplicates_by_key(t: Tables):
    """Rows that share a key: each with its group's smallest id."""
    return same_key_groups(t.part, F.concat_ws("|", "p_brand", "p_size", "p_type"), "p_partkey")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey),
n AS (SELECT DISTINCT a FROM e), r AS (SELECT a, a AS x FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x)
SELECT a AS id, min(x) AS component FROM r GROUP BY 1
""")
def linked_suppliers(t: Tables):
    """Transitive groups: suppliers that share an order."""
    l = t.lineitem.select("l_orderkey", "l_suppkey")
    links = same_key_links(l, F.col("l_orderkey"), "l_suppkey")
    every = l.select(F.col("l_suppkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return components(links.union(every))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_shipdate = b.l_shipdate AND a.l_orderkey <> b.l_orderkey),
n AS (SELECT DISTINCT a FROM e), r AS (SELECT a, a AS x FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x)
SELECT a AS id, min(x) AS component FROM r GROUP BY 1
""")
def linked_orders(t: Tables):
    """Transitive groups of many sizes: orders that ship the same part on the same day."""
    links = same_key_links(t.lineitem, F.concat_ws("|", "l_partkey", "l_shipdate"), "l_orderkey")
    return components(links.where("a <> b"))


@query("""
WITH s1 AS (SELECT p_partkey, min(p_partkey) OVER w AS group_id, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_size, p_type)),
a AS (SELECT p_partkey, group_id, 'key' AS stage FROM s1 WHERE n > 1),
s2 AS (SELECT p_partkey, min(p_partkey) OVER w AS group_id, count(*) OVER w AS n FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a) WINDOW w AS (PARTITION BY p_brand, p_type))
SELECT * FROM a UNION ALL SELECT p_partkey, group_id, 'series' FROM s2 WHERE n > 1
""")
def staged_duplicate_groups(t: Tables):
    """Stages in order; a row that one stage groups is left out of the next."""
    return staged_duplicates(t.part, "p_partkey", [("key", F.concat_ws("|", "p_brand", "p_size", "p_type")), ("series", F.concat_ws("|", "p_brand", "p_type"))])


@query("""
SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS keeper, count(*) AS members FROM part GROUP BY 1
""")
def duplicate_keepers(t: Tables):
    """Of each group the row with the best rank, then the lowest id."""
    return keepers(t.part, "p_brand", [F.col("p_size")], "p_partkey")


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents), g AS (SELECT k, min(doc_id) AS group_id, count(*) AS n FROM d GROUP BY 1)
SELECT doc_id, group_id FROM d JOIN g USING (k) WHERE n > 1
""")
def same_text_groups(t: Tables):
    """Documents with the same normalised text, by its digest."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    return same_key_groups(t.documents, key, "doc_id")


@query("""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM n WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query, n.vec_id AS other, list_cosine_similarity(q.v, n.v) AS score FROM q JOIN n ON q.vec_id <> n.vec_id)
SELECT query, other, round(score, 6) AS score FROM s WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, other) <= 25
""")
def similar_vectors(t: Tables):
    """The 25 best neighbours above 0.1 of a stated query set (every 50th vector), against all vectors."""
    found = top_similar(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 50 = 0"))
    return found.select("query", "other", F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT label, embedding, vec_id FROM embeddings), c AS (SELECT label, min(vec_id) AS first_id FROM n GROUP BY 1)
SELECT n.vec_id, round(list_dot_product(n.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS dot FROM n JOIN c USING (label) JOIN n f ON f.vec_id = c.first_id
""")
def dot_with_first(t: Tables):
    """Dot product of each vector with the first of its label."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return t.embeddings.join(first, "label").select("vec_id", F.round(dot(F.col("embedding"), F.col("f")), 6).alias("dot"))


@query("""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_component FROM n
""")
def unit_vectors(t: Tables):
    return t.embeddings.select("vec_id", F.round(F.element_at(normalised(F.col("embedding")), 1), 6).alias("first_component"))


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_size, p_retailprice, list_distinct(string_split(lower(p_type), ' ')) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b,
       round(2.0 * 1 + 3.5 * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) + 0.6 * (1 - least(abs(a.p_retailprice - b.p_retailprice) / 5, 1)), 5) AS score
FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
""")
def pairwise_similarity(t: Tables):
    """Weighted similarity of items that share a block (series and number).

    The rows are all pairs of a block. Items that say the same are lists of about 64: two lists are scored once, then paired item by item.
    """
    says = ["p_brand", "p_size", "p_retailprice", "p_type"]
    part = t.part
    alike = part.groupBy(*says).agg(F.count("*").alias("n")).withColumnsRenamed({c: f"_{c}" for c in says})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in says))
    placed = part.join(alike, same).select(*says, "p_partkey", F.pmod(F.xxhash64("p_partkey"), F.ceil(F.col("n") / 64)).alias("list"))
    lists = placed.groupBy(*says, "list").agg(F.array_sort(F.collect_list("p_partkey")).alias("items"))
    lists = lists.select("p_brand", "p_size", "p_retailprice", names(F.split("p_type", " ")).alias("w"), "items", F.get("items", F.lit(0)).alias("first"))
    # a block's left lists are dealt to eight tasks
    a = spread(lists.withColumn("deal", F.pmod(F.xxhash64("first"), F.lit(8))), "p_brand", "p_size", "deal").alias("a")
    b = spread(lists.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))), "p_brand", "p_size", "deal").alias("b")
    block = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_size", "deal")))
    joined = a.join(b, block & (F.col("a.first") <= F.col("b.first")))
    zero = F.lit(0.0)
    score = similarity(zero, F.lit(1.0), zero, shared(F.col("a.w"), F.col("b.w")), rating_proximity(F.col("a.p_retailprice"), F.col("b.p_retailprice")))
    scored = joined.select(score.alias("score"), F.col("a.items").alias("left"), F.col("b.items").alias("right"), (F.col("a.first") < F.col("b.first")).alias("apart"))
    pairs = scored.select("score", "right", "apart", F.explode("left").alias("x")).select("score", "apart", "x", F.explode("right").alias("y"))
    pairs = pairs.where((F.col("x") < F.col("y")) | F.col("apart") & (F.col("x") > F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


@query("""
WITH o AS (SELECT l_suppkey AS target, l_partkey AS item, p_brand, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY target, p_brand ORDER BY score DESC, item) <= 3)
SELECT target, item, score FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, item) <= 25
""")
def recommendations_capped(t: Tables):
    """At most three recommendations an author for each target, greedily in score order."""
    o = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    scored = o.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("item"), F.array("p_brand").alias("authors"), F.col("score").cast("double").alias("score"))
    return capped_per_author(scored, "target", "authors", count=t.lineitem.count())


_PROVIDERS = """
WITH p AS (SELECT l_partkey AS book, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS provider, CASE WHEN l_quantity > 10 THEN l_returnflag END AS flag, l_linestatus AS status FROM lineitem)
"""


@query(_PROVIDERS + """
SELECT book, coalesce(max(flag) FILTER (provider = 'a'), max(flag) FILTER (provider = 'b'), max(flag) FILTER (provider = 'c')) AS flag,
       coalesce(max(status) FILTER (provider = 'c'), max(status) FILTER (provider = 'a')) AS status FROM p GROUP BY 1
""")
def provider_merge(t: Tables):
    """Each field from the first provider in its own order that has a value."""
    n = F.col("l_linenumber") % 3
    rows = t.lineitem.select(F.col("l_partkey").alias("book"), F.when(n == 0, "a").when(n == 1, "b").otherwise("c").alias("provider"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"))
    return merged_by_priority(rows, "book", "provider", {"flag": ["a", "b", "c"], "status": ["c", "a"]})


@query("""
SELECT p_partkey, 'new' AS whole, CASE WHEN p_size > 25 THEN 'new' ELSE p_name END AS missing, coalesce(CASE WHEN p_size % 2 = 0 THEN 'new' END, p_name) AS provided, p_name AS locked FROM part
""")
def replace_modes(t: Tables):
    """ALL, MISSING and WHEN_PROVIDED updates, and a locked field."""
    blank = F.when(F.col("p_size") <= 25, F.col("p_name"))
    given = F.when(F.col("p_size") % 2 == 0, "new")
    return t.part.select("p_partkey", replaced(F.col("p_name"), F.lit("new"), "ALL").alias("whole"), replaced(blank, F.lit("new"), "MISSING").alias("missing"), replaced(F.col("p_name"), given, "WHEN_PROVIDED").alias("provided"), replaced(F.col("p_name"), F.lit("new"), "ALL", F.lit(True)).alias("locked"))


@query("""
WITH x AS (SELECT o_orderkey, o_orderstatus AS s1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s2, o_totalprice AS p1, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS p2 FROM orders)
SELECT o_orderkey, [v for v in [CASE WHEN s1 IS DISTINCT FROM s2 THEN 'status' END, CASE WHEN p1 IS DISTINCT FROM p2 AND o_orderkey % 2 = 0 THEN 'price' END] if v IS NOT NULL] AS fields FROM x
""")
def detected_changes(t: Tables):
    """Names of changed fields; a lock hides a field."""
    k = F.col("o_orderkey")
    old = {"status": F.col("o_orderstatus"), "price": F.col("o_totalprice")}
    new = {"status": F.when(k % 5 != 0, F.col("o_orderstatus")), "price": F.when(k % 3 == 0, 0.0).otherwise(F.col("o_totalprice"))}
    return t.orders.select("o_orderkey", changed_fields(old, new, {"price": k % 2 != 0}).alias("fields"))


@query("""
WITH x AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part),
m AS (SELECT p_partkey, CASE WHEN w IN ('SMALL', 'MEDIUM') THEN 'SIZED' WHEN w = 'BRASS' THEN NULL ELSE w END AS v, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT p_partkey, coalesce(list(v ORDER BY pos) FILTER (v IS NOT NULL), []) AS words FROM m GROUP BY 1
""")
def consolidated_values(t: Tables):
    """Values merged under a new name, or deleted, in their order."""
    mapping = t.spark.createDataFrame([("SMALL", "SIZED"), ("MEDIUM", "SIZED"), ("BRASS", None)], "old string, new string")
    return consolidated(t.part.select("p_partkey", F.split("p_type", " ").alias("words")), "words", F.broadcast(mapping))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 9 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.id = b.id
""")
def snapshot_compare(t: Tables):
    """Change data of two snapshots in one full join."""
    k = F.col("o_orderkey")
    a = t.orders.where(k % 4 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("s"))
    b = t.orders.where(k % 9 != 0).select(k.alias("id"), F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return compare(a, b, ["id"], ["s"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders
""")
def upserted_orders(t: Tables):
    """Stored rows with newer incoming ones in place."""
    stored = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    incoming = stored.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return upsert(stored, incoming, ["o_orderkey"], "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')")
def purged_rows(t: Tables):
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderdate").alias("deleted_at"))
    return purged(rows, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_purge(t: Tables):
    """Rows that something still refers to."""
    return without_orphans(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_update(t: Tables):
    ids = t.customer.join(t.nation.where("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    return bulk_set(t.customer.select("c_custkey", "c_mktsegment"), ids, "c_custkey", {"c_mktsegment": "MOVED"})


@query("""
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 5
""")
def newest_five(t: Tables):
    """The newest five of each kind."""
    return newest_per(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "role"], [F.desc("turn")], 5)


@query("""
WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, q FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) <= 3
""")
def top_items_per_supplier(t: Tables):
    s = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey"))
    return s.withColumn("k", k).where("k <= 3").drop("k")


@query("""
SELECT item_id, trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'ø', 'o'), 'æ', 'ae'), 'œ', 'oe'), 'ł', 'l')), '[!@$%^&*_=|~`<>?/"]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM benchmark
""")
def normalised_titles(t: Tables):
    """Search keys of items."""
    return t.benchmark.select("item_id", search_key(F.col("text")).alias("key"))
