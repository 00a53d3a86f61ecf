"""Predicates, joins, aggregates, set operations, sorting and paging over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scope import not_deleted, visible
from ..operators.sets import added, changed, removed, union_tagged, zero_filled
from .registry import Tables, query


@query("SELECT c_custkey, c_name FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def soft_delete_filter(t: Tables):
    """Rows that aren't marked deleted; an unknown mark counts as not deleted."""
    return t.customer.withColumn("deleted", F.col("c_acctbal") < 0).where(not_deleted("deleted")).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def visible_rows(t: Tables):
    """Row-level visibility: not deleted and in an assigned library."""
    assigned = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("library_id"))
    books = t.customer.select("c_custkey", F.col("c_nationkey").alias("library_id"), (F.col("c_acctbal") < 0).alias("deleted"))
    return visible(books, assigned).select("c_custkey")


@query("SELECT p_partkey, coalesce(nullif(p_type, ''), p_name, 'none') AS label FROM part")
def fallback_label(t: Tables):
    return t.part.select("p_partkey", F.coalesce(F.nullif(F.col("p_type"), F.lit("")), F.col("p_name"), F.lit("none")).alias("label"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def half_open_range(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.where((d >= F.lit("1997-01-01").cast("timestamp_ntz")) & (d < F.lit("1997-02-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def literal_contains(t: Tables):
    """Search over several columns without wildcards."""
    return t.part.where(F.lower("p_name").contains("an") | F.lower("p_type").contains("an")).select("p_partkey", "p_name")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) = '/en' OR starts_with(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/en/')")
def path_prefix(t: Tables):
    """A path or anything below it."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return t.pages.where((path == "/en") | path.startswith("/en/")).select("page_id", "url")


@query("""
SELECT DISTINCT least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(a.value - b.value) < 0.05 AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE)
""")
def near_marks(t: Tables):
    """Marks of one user, type and day that lie within a tolerance: cells of the tolerance's width meet their neighbours only."""
    cell = F.floor(F.col("value") / 0.05)
    e = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")
    a = e.withColumn("cell", cell).alias("a")
    b = e.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("user_id", "event_type", "day", "cell")]
    close = (F.abs(F.col("a.value") - F.col("b.value")) < 0.05) & (F.col("a.event_id") < F.col("b.event_id"))
    return a.join(b, keys).where(close).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")).distinct()


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'READ' WHEN o_totalprice > 100000 THEN 'READING' ELSE 'UNREAD' END AS status FROM orders
""")
def status_by_progress(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p >= 300000, "READ").when(p > 100000, "READING").otherwise("UNREAD").alias("status"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45")
def bridge_join(t: Tables):
    """n:m through the mapping table; the dimension sides may be broadcast when they are small."""
    l = t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.join(t.part, l.l_partkey == F.col("p_partkey")).join(t.supplier, l.l_suppkey == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("""
SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1
""")
def left_join_filtered(t: Tables):
    """Left join with a condition on the right side, filtered before the join; keys without a match count 0."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("urgent"))


@query("""
WITH m AS (SELECT l_orderkey, min(l_linenumber) AS k FROM lineitem GROUP BY 1)
SELECT o_orderkey, l.l_partkey AS first_part FROM orders JOIN m ON m.l_orderkey = o_orderkey JOIN lineitem l ON l.l_orderkey = o_orderkey AND l.l_linenumber = m.k
""")
def first_item(t: Tables):
    """Each parent with its first child: one aggregate instead of a join to a minimum."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", "l_linenumber").alias("first_part"), F.min("l_linenumber").alias("k"))
    kept = first.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").where("l_linenumber = k")
    return t.orders.join(kept, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("l_partkey").alias("first_part"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(t: Tables):
    done = t.orders.where("o_orderstatus = 'F'")
    return t.customer.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_join(t: Tables):
    """Customers without a finished urgent order."""
    urgent = t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT o_orderpriority, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1
""")
def latest_per_group(t: Tables):
    """The newest rows of each group, ties kept: the groups' maxima join back, so a hot group is never one window."""
    newest = t.orders.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(newest, ["o_orderpriority", "o_orderdate"]).select("o_orderpriority", "o_orderkey", "o_orderdate")


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def universe_pairs(t: Tables):
    """All pairs of two fixed-size key universes (25 nations, 5 regions)."""
    return F.broadcast(t.region).crossJoin(t.nation).select("r_regionkey", "n_nationkey")


@query("""
SELECT n_nationkey, n_name, coalesce(c, 0) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey
""")
def zero_filled_counts(t: Tables):
    counted = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return zero_filled(t.nation.select("n_nationkey", "n_name"), counted, "n_nationkey", "customers")


@query("""
SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
       min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1
""")
def grouped_aggregates(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 4).alias("mean"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts")
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
FROM orders GROUP BY 1, 2
""")
def status_pivot(t: Tables):
    """Month by status."""
    s = F.col("o_orderstatus")
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(*[F.count_if(s == x).alias(x.lower()) for x in "FOP"])


@query("SELECT l_orderkey, bool_and(l_returnflag = 'N') AS untouched FROM lineitem GROUP BY 1")
def all_true_per_group(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("untouched"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1")
def collected_sets(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


@query("SELECT DISTINCT p_brand, p_size FROM part ORDER BY 1, 2")
def distinct_ordered(t: Tables):
    return t.part.select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def having_two(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers >= 2")


@query("""
SELECT 'user' AS kind, conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'
UNION ALL SELECT 'assistant', conv_id, turn, length(text) FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'system', conv_id, turn, length(text) FROM conversations WHERE role = 'system'
""")
def tagged_union(t: Tables):
    """Three sources under one schema, each with its tag."""
    sources = {role: t.conversations.where(F.col("role") == role).select("conv_id", "turn", F.length("text").cast("long").alias("n")) for role in ("user", "assistant", "system")}
    return union_tagged(sources, "kind")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""
WITH u AS (SELECT role AS k FROM conversations UNION ALL SELECT event_type FROM events) SELECT k, count(*) AS n FROM u GROUP BY 1
""")
def union_counts(t: Tables):
    return t.conversations.select(F.col("role").alias("k")).union(t.events.select("event_type")).groupBy("k").agg(F.count("*").alias("n"))


#: Two snapshots of the orders: the old one lacks every 7th order, the new one every 11th; every 5th changed.
OLD, NEW = "o_orderkey % 7 <> 0", "o_orderkey % 11 <> 0"
_SNAPSHOTS = f"""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS hash, o_orderdate AS at FROM orders WHERE {OLD}),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS hash, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS at FROM orders WHERE {NEW})
"""


def _snapshots(t: Tables):
    a = t.orders.where(OLD).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("at"))
    hashed, at = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return a, t.orders.where(NEW).select(F.col("o_orderkey").alias("id"), hashed.alias("hash"), at.alias("at"))


@query(_SNAPSHOTS + "SELECT id FROM b WHERE id NOT IN (SELECT id FROM a)")
def snapshot_added(t: Tables):
    a, b = _snapshots(t)
    return added(a, b, ["id"]).select("id")


@query(_SNAPSHOTS + "SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def snapshot_removed(t: Tables):
    a, b = _snapshots(t)
    return removed(a, b, ["id"]).select("id")


@query(_SNAPSHOTS + "SELECT b.id FROM a JOIN b USING (id) WHERE coalesce(a.hash <> b.hash, false) OR coalesce(a.at <> b.at, false) OR (a.at IS NULL AND b.at IS NOT NULL)")
def snapshot_changed(t: Tables):
    """Changed rows; a time that became null is not a change."""
    a, b = _snapshots(t)
    return changed(a, b, ["id"], ["hash"], ["at"]).select("id")


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def keys_in_both(t: Tables):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.where("c_acctbal > 9900").select("c_nationkey"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sorted_page(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS number FROM part) SELECT p_partkey, coalesce(number, 999999) AS rank FROM x ORDER BY rank, p_partkey LIMIT 100
""")
def nulls_last_page(t: Tables):
    number = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    return t.part.select("p_partkey", F.coalesce(number, F.lit(999999)).alias("rank")).orderBy("rank", "p_partkey").limit(100)


@query("""
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5
""")
def top_per_group(t: Tables):
    """Five a group (the report is a top-k)."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("k", k).where("k <= 5").select("p_brand", "p_partkey", "p_retailprice")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS rank FROM orders ORDER BY rank, o_orderdate DESC, o_orderkey LIMIT 50
""")
def refresh_queue(t: Tables):
    """Three-key queue: rank, then newest, then lowest key."""
    rank = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return t.orders.select("o_orderkey", rank.alias("rank"), "o_orderdate").orderBy("rank", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "rank")


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('7:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 20")
def random_row(t: Tables):
    """A random row of the dashboard, by a seeded hash: a sampling operator."""
    order = F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string")).cast("binary"))
    return t.part.orderBy(order, "p_partkey").limit(20).select("p_partkey", "p_name")
