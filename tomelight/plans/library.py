"""Library and profile reports over orders, part, customer and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import decade, free_text_year
from ..functions.numbers import banded, half_up
from .registry import Tables, query

RUNNING = (Window.unboundedPreceding, 0)


@query("""
WITH l AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, round(n * 100.0 / sum(n) OVER (), 4) AS share FROM l ORDER BY n DESC, lang LIMIT 15
""")
def language_shares(t: Tables):
    """The 15 most frequent languages and their share of known ones."""
    l = t.documents.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return l.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4)).orderBy(F.desc("n"), "lang").limit(15)


@query("SELECT l_returnflag, l_linestatus, count(*) AS items, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2")
def format_totals(t: Tables):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""
SELECT CASE WHEN b BETWEEN 0 AND 49 THEN 'low' WHEN b BETWEEN 50 AND 69 THEN 'fair' WHEN b BETWEEN 70 AND 89 THEN 'good' WHEN b BETWEEN 90 AND 100 THEN 'high' ELSE 'none' END AS band, count(*) AS n, round(avg(b), 4) AS mean
FROM (SELECT c_acctbal / 100 AS b FROM customer) GROUP BY 1
""")
def score_bands(t: Tables):
    """Integer bands: a score between two bands is in none."""
    b = F.col("c_acctbal") / 100
    band = F.coalesce(banded(b, [("low", 0, 49), ("fair", 50, 69), ("good", 70, 89), ("high", 90, 100)]), F.lit("none"))
    return t.customer.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(b), 4).alias("mean"))


@query("""
WITH x AS (SELECT unnest(string_split(p_type, ' ')) AS item, CASE WHEN p_retailprice > 1000 THEN 'read' ELSE 'unread' END AS status FROM part),
c AS (SELECT item, count(*) FILTER (status = 'read') AS read, count(*) FILTER (status = 'unread') AS unread FROM x GROUP BY 1)
SELECT item, read, unread FROM c ORDER BY read + unread DESC, item LIMIT 15
""")
def top_items_by_status(t: Tables):
    x = t.part.select(F.explode(F.split("p_type", " ")).alias("item"), (F.col("p_retailprice") > 1000).alias("done"))
    c = x.groupBy("item").agg(F.count_if("done").alias("read"), F.count_if(~F.col("done")).alias("unread"))
    return c.orderBy(F.desc(F.col("read") + F.col("unread")), "item").limit(15)


@query("""
WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS books, count(DISTINCT l_orderkey) AS orders, round(avg(l_quantity), 4) AS mean, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1)
SELECT l_suppkey, books, orders, mean, revenue FROM s WHERE books >= 2 ORDER BY books DESC, l_suppkey LIMIT 50
""")
def author_universe(t: Tables):
    """The 50 authors with the most books, of those with two or more."""
    s = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("books"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return s.where("books >= 2").orderBy(F.desc("books"), "l_suppkey").limit(50)


@query("""
WITH f AS (SELECT 'printed in ' || CAST(1000 + o_orderkey * 37 % 1100 AS VARCHAR) || ', again ' || CAST(year(o_orderdate) AS VARCHAR) AS note FROM orders),
y AS (SELECT CAST(regexp_extract(note, '(\\d{4})', 1) AS INTEGER) AS y FROM f), k AS (SELECT y FROM y WHERE y BETWEEN 1000 AND 2099)
SELECT CASE WHEN y < 1900 THEN 'before 1900' WHEN y >= 2020 THEN '2020s' ELSE CAST(y // 10 * 10 AS VARCHAR) || 's' END AS decade, count(*) AS n FROM k GROUP BY 1
""")
def publication_timeline(t: Tables):
    """Decades of the first four-digit year found in a text."""
    note = F.concat(F.lit("printed in "), (1000 + F.col("o_orderkey") * 37 % 1100).cast("string"), F.lit(", again "), F.year("o_orderdate").cast("string"))
    return t.orders.select(free_text_year(note, 2099).alias("y")).where("y is not null").groupBy(decade(F.col("y")).alias("decade")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM c),
d AS (SELECT r.y, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (y)), s AS (SELECT y, n, sum(n) OVER (ORDER BY y RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS span FROM d)
SELECT CAST(y AS INTEGER) AS y, n, CAST(span AS BIGINT) AS span, y = (SELECT min(y) FROM s WHERE span = (SELECT max(span) FROM s)) AS best FROM s
""")
def publication_trend(t: Tables):
    """Years without gaps, the sum of each five-year span, and the best span (the first, if several)."""
    c = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    years = c.agg(F.min("y").alias("a"), F.max("y").alias("b")).select(F.explode(F.sequence("a", "b")).alias("y"))
    d = years.join(c, "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"))
    s = d.withColumn("span", F.sum("n").over(Window.orderBy("y").rangeBetween(0, 4)))
    best = s.agg(F.min_by("y", F.struct(-F.col("span"), F.col("y"))).alias("best_y"))
    return s.join(F.broadcast(best)).select("y", "n", "span", (F.col("y") == F.col("best_y")).alias("best"))


@query("""
WITH a AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS added FROM orders GROUP BY 1), f AS (SELECT date_trunc('month', l_shipdate) AS m, count(*) AS finished FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
k AS (SELECT unnest(generate_series((SELECT min(m) FROM a), (SELECT max(m) FROM f), INTERVAL 1 MONTH)) AS m)
SELECT strftime(k.m, '%Y-%m') AS month, coalesce(added, 0) AS added, coalesce(finished, 0) AS finished, CAST(sum(coalesce(added, 0)) OVER w AS BIGINT) AS all_added, CAST(sum(coalesce(finished, 0)) OVER w AS BIGINT) AS all_finished,
       CAST(sum(coalesce(added, 0) - coalesce(finished, 0)) OVER w AS BIGINT) AS backlog
FROM k LEFT JOIN a ON a.m = k.m LEFT JOIN f ON f.m = k.m WINDOW w AS (ORDER BY k.m)
""")
def reading_journey(t: Tables):
    """Months without gaps: added, finished, running totals and the backlog (one row a month)."""
    month = lambda c: F.trunc(F.to_date(c), "month")
    a = t.orders.groupBy(month("o_orderdate").alias("m")).agg(F.count("*").alias("added"))
    f = t.lineitem.where("l_linenumber = 1").groupBy(month("l_shipdate").alias("m")).agg(F.count("*").alias("finished"))
    bounds = a.agg(F.min("m").alias("lo")).join(f.agg(F.max("m").alias("hi")))
    k = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    w = Window.orderBy("m").rowsBetween(*RUNNING)
    x = k.join(a, "m", "left").join(f, "m", "left").select("m", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("finished", F.lit(0)).alias("finished"))
    return x.select(F.date_format("m", "yyyy-MM").alias("month"), "added", "finished", F.sum("added").over(w).alias("all_added"), F.sum("finished").over(w).alias("all_finished"), F.sum(F.col("added") - F.col("finished")).over(w).alias("backlog"))


@query("""
SELECT count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses, round(sum(o_totalprice) / 1048576, 2) AS mb FROM orders
""")
def library_summary(t: Tables):
    return t.orders.agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("statuses"), F.round(F.sum("o_totalprice") / 1048576, 2).alias("mb"))


@query("""
SELECT p_brand, count(*) AS total, count(*) FILTER (p_retailprice > 1000) AS read, round(count(*) FILTER (p_retailprice > 1000) * 100.0 / count(*), 4) AS percent,
       CASE WHEN count(*) FILTER (p_retailprice > 1000) = count(*) THEN 'done' WHEN count(*) FILTER (p_retailprice > 1000) > 0 THEN 'started' ELSE 'new' END AS status FROM part GROUP BY 1
""")
def series_progress(t: Tables):
    n, read = F.count("*"), F.count_if(F.col("p_retailprice") > 1000)
    return t.part.groupBy("p_brand").agg(n.alias("total"), read.alias("read"), F.round(read * 100.0 / n, 4).alias("percent"), F.when(read == n, "done").when(read > 0, "started").otherwise("new").alias("status"))


@query("""
WITH x AS (SELECT p_partkey, p_size / 10.0 AS own, p_retailprice / 400.0 AS others FROM part)
SELECT CASE WHEN own >= 2.5 THEN CASE WHEN others >= 3 THEN 'both' ELSE 'mine' END ELSE CASE WHEN others >= 3 THEN 'theirs' ELSE 'neither' END END AS quadrant, count(*) AS n, round(avg(own - others), 4) AS deviation FROM x GROUP BY 1
""")
def rating_taste(t: Tables):
    x = t.part.select((F.col("p_size") / 10.0).alias("own"), (F.col("p_retailprice") / 400.0).alias("others"))
    high = F.col("others") >= 3
    quadrant = F.when(F.col("own") >= 2.5, F.when(high, "both").otherwise("mine")).otherwise(F.when(high, "theirs").otherwise("neither"))
    return x.groupBy(quadrant.alias("quadrant")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("own") - F.col("others")), 4).alias("deviation"))


@query("""
WITH b AS (SELECT CASE WHEN p_size <= 10 THEN 'a' WHEN p_size <= 20 THEN 'b' WHEN p_size <= 30 THEN 'c' WHEN p_size <= 40 THEN 'd' ELSE 'e' END AS bin, p_retailprice FROM part),
l AS (SELECT regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS base FROM part)
SELECT bin, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(any_value(slope), 6) AS slope, round(any_value(base), 4) AS base FROM b, l GROUP BY 1 HAVING count(*) >= 2
""")
def length_sweet_spot(t: Tables):
    """Mean rating by length, bins of two or more, with the trend line."""
    s = F.col("p_size")
    bin_ = F.when(s <= 10, "a").when(s <= 20, "b").when(s <= 30, "c").when(s <= 40, "d").otherwise("e")
    line = t.part.agg(F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("base"))
    x = t.part.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")).where("n >= 2")
    return x.join(F.broadcast(line)).select("bin", "n", "mean", "slope", "base")


@query("""
SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2
""")
def book_flow(t: Tables):
    """Counts from quarter to status."""
    q = F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"))
    return t.orders.groupBy(q.alias("quarter"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
SELECT o_custkey, count(gap) AS gaps, round(median(gap), 1) AS median_gap, max(gap) AS longest FROM d GROUP BY 1
""")
def completion_race_stats(t: Tables):
    gap = F.date_diff(F.col("o_orderdate"), F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    d = t.orders.select("o_custkey", gap.cast("long").alias("gap"))
    return d.groupBy("o_custkey").agg(F.count("gap").alias("gaps"), F.round(F.median("gap"), 1).alias("median_gap"), F.max("gap").alias("longest"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) > (SELECT max(year(o_orderdate)) FROM orders) - 10 GROUP BY 1, 2")
def completion_heatmap(t: Tables):
    """Finished a month, the last ten years."""
    last = t.orders.agg(F.max(F.year("o_orderdate")).alias("last"))
    x = t.orders.where("o_orderstatus = 'F'").join(F.broadcast(last)).where(F.year("o_orderdate") > F.col("last") - 10)
    return x.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, n, done, round(floor(done * 10000.0 / n + 0.5) / 100, 4) AS rate FROM m
""")
def completion_timeline(t: Tables):
    done = F.count_if(F.col("o_orderstatus") == "F")
    x = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), done.alias("done"))
    return x.select("month", "n", "done", F.round(half_up(F.col("done") * 100.0 / F.col("n"), 2), 4).alias("rate"))


@query("""
WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, n, round(n * 100.0 / sum(n) OVER (), 4) AS share FROM s
""")
def status_shares(t: Tables):
    s = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return s.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


@query("""
WITH d AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), i AS (SELECT o_custkey, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS k FROM d),
r AS (SELECT o_custkey, k, count(*) AS n FROM i GROUP BY 1, 2) SELECT o_custkey, max(n) AS months FROM r GROUP BY 1
""")
def month_streaks(t: Tables):
    """Longest run of consecutive months with activity."""
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    d = t.orders.select("o_custkey", m.alias("m")).distinct()
    i = d.withColumn("k", F.col("m") - F.row_number().over(Window.partitionBy("o_custkey").orderBy("m")))
    return i.groupBy("o_custkey", "k").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.max("n").alias("months"))


@query("""
WITH y AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT CAST(y AS INTEGER) AS y, CAST(arg_max(m, (n, -m)) AS INTEGER) AS best_month, max(n) AS n FROM y GROUP BY 1
""")
def best_months(t: Tables):
    """Most productive month of each year; the first of equal ones."""
    y = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return y.groupBy("y").agg(F.max_by("m", F.struct("n", -F.col("m"))).alias("best_month"), F.max("n").alias("n"))


@query("""
SELECT c_custkey, round(25 * least(count(o_orderkey) / 10.0, 1) + 25 * least(count(DISTINCT o_orderpriority) / 5.0, 1) + 50 * coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 0), 4) AS score
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def reading_profile(t: Tables):
    """A profile score of volume, variety and completion; customers without orders score 0."""
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("done"))
    zero, one = F.lit(0), F.lit(1.0)
    score = 25 * F.least(F.coalesce("n", zero) / 10.0, one) + 25 * F.least(F.coalesce("kinds", zero) / 5.0, one) + 50 * F.coalesce("done", F.lit(0.0))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round(score, 4).alias("score"))
