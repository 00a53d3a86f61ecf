"""Rules, series rules and metadata presence over the part table as a catalogue of books."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rules import Field, compile_rule
from ..operators.scope import restricted
from .registry import Tables, query

NOW = datetime.datetime(1998, 8, 2, 12)


def books(t: Tables):
    """part as books: title, series (brand), number (size), price, words of the type as a list."""
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.split("p_type", " ").alias("words"))


def part_schema() -> dict[str, Field]:
    return {
        "title": Field(F.col("p_name"), "text"),
        "series": Field(F.col("p_brand"), "text"),
        "type": Field(F.col("p_type"), "text"),
        "pages": Field(F.col("p_size"), "number"),
        "price": Field(F.col("p_retailprice"), "number"),
        "tags": Field(F.col("words"), "list"),
        "publisher": Field(F.when(F.col("p_size") % 7 != 0, F.when(F.col("p_size") % 7 == 1, " \t").otherwise(F.col("p_brand"))), "text"),
    }


def order_schema() -> dict[str, Field]:
    return {"date": Field(F.col("o_orderdate"), "date"), "status": Field(F.col("o_orderstatus"), "text"), "price": Field(F.col("o_totalprice"), "number")}


def _and(*rules):
    return {"type": "group", "join": "and", "rules": list(rules)}


def _or(*rules):
    return {"type": "group", "join": "or", "rules": list(rules)}


def _leaf(field, operator, value=None, start=None, end=None):
    return {"field": field, "operator": operator, "value": value, "valueStart": start, "valueEnd": end}


#: name -> (rule, the same as a DuckDB condition)
PART_RULES = {
    "rule_equals": (_and(_leaf("series", "equals", "BRAND#11")), "lower(p_brand) = 'brand#11'"),
    "rule_not_equals": (_and(_leaf("series", "not_equals", "Brand#11")), "lower(p_brand) <> 'brand#11'"),
    "rule_contains": (_or(_leaf("title", "contains", "An"), _leaf("type", "contains", "STEEL")), "contains(lower(p_name), 'an') OR contains(lower(p_type), 'steel')"),
    "rule_not_contains": (_and(_leaf("title", "does_not_contain", "e")), "NOT contains(lower(p_name), 'e')"),
    "rule_starts_ends": (_or(_leaf("title", "starts_with", "S"), _leaf("title", "ends_with", "ING")), "starts_with(lower(p_name), 's') OR ends_with(lower(p_name), 'ing')"),
    "rule_compare": (_and(_leaf("pages", "greater_than", "10"), _leaf("pages", "less_than_equal_to", 30), _leaf("price", "greater_than_equal_to", 950), _leaf("price", "less_than", "1500.5")), "p_size > 10 AND p_size <= 30 AND p_retailprice >= 950 AND p_retailprice < 1500.5"),
    "rule_between": (_and(_leaf("pages", "in_between", None, 5, 12)), "p_size BETWEEN 5 AND 12"),
    "rule_empty": (_or(_leaf("publisher", "is_empty"), _leaf("tags", "is_empty")), "p_size % 7 IN (0, 1) OR p_type IS NULL"),
    "rule_not_empty": (_and(_leaf("title", "is_not_empty")), "trim(p_name) <> ''"),
    "rule_includes_any": (_and(_leaf("series", "includes_any", ["Brand#11", "brand#22"])), "lower(p_brand) IN ('brand#11', 'brand#22')"),
    "rule_includes_all": (_and(_leaf("tags", "includes_all", [])), "true"),
    "rule_excludes_all": (_and(_leaf("series", "excludes_all", ["Brand#11", "Brand#12"])), "lower(p_brand) NOT IN ('brand#11', 'brand#12')"),
    "rule_nested": (_and(_or(_leaf("pages", "less_than", 5), _leaf("pages", "greater_than", 45)), _or(_leaf("series", "contains", "#1"), _and(_leaf("price", "greater_than", 1200), _leaf("pages", "not_equals", 50)))), "(p_size < 5 OR p_size > 45) AND (contains(p_brand, '#1') OR (p_retailprice > 1200 AND p_size <> 50))"),
    "rule_empty_groups": (_or(_and(), _or()), "true"),
    "rule_unreadable": (_or(_leaf("nonsense", "equals", 1), _leaf("pages", "equals", 7)), "p_size = 7"),
}
ORDER_RULES = {
    "rule_dates": (_and(_leaf("date", "in_between", None, "1996-01-01", "1996-12-31"), _leaf("status", "not_equals", "p")), "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus <> 'P'"),
    "rule_within_last": (_and(_leaf("date", "within_last", 45, end="days")), "o_orderdate >= TIMESTAMP '1998-06-18 12:00:00'"),
    "rule_older_than": (_and(_leaf("date", "older_than", 18, end="months")), "o_orderdate < TIMESTAMP '1997-02-02'"),
    "rule_this_period": (_and(_leaf("date", "this_period", "year")), "o_orderdate >= TIMESTAMP '1998-01-01'"),
}


def _register() -> None:
    def rule_query(name, rule, condition, table, key, schema):
        def run(t: Tables):
            rows = books(t) if table == "part" else t.orders
            return rows.where(compile_rule(rule, schema(), NOW)).select(key)

        run.__name__ = name
        query(f"SELECT {key} FROM {table} WHERE {condition}")(run)

    for name, (rule, condition) in PART_RULES.items():
        rule_query(name, rule, condition, "part", "p_partkey", part_schema)
    for name, (rule, condition) in ORDER_RULES.items():
        rule_query(name, rule, condition, "orders", "o_orderkey", order_schema)


_register()


@query("""
SELECT p_brand, count(*) AS books, count(DISTINCT p_size) AS numbers, min(p_size) > 1 AS missing_first, max(p_size) - count(DISTINCT p_size) > 0 AS any_gap, count(*) > count(DISTINCT p_size) AS duplicate_number
FROM part GROUP BY 1
""")
def series_gaps(t: Tables):
    """A series by its numbers: gaps, a missing first, numbers held twice."""
    number = F.floor("p_size")
    n = F.countDistinct(number)
    return t.part.groupBy("p_brand").agg(F.count("*").alias("books"), n.alias("numbers"), (F.min(number) > 1).alias("missing_first"), (F.max(number) - n > 0).alias("any_gap"), (F.count("*") > n).alias("duplicate_number"))


@query("""
SELECT p_brand, bool_and(p_retailprice > 1000) AS fully_read, bool_or(p_retailprice > 1000) AND NOT bool_and(p_retailprice > 1000) AS reading, NOT bool_or(p_retailprice > 1000) AS not_started FROM part GROUP BY 1
""")
def series_status(t: Tables):
    """Roll-up of the read status (read: a price above 1000) over a series."""
    read = F.coalesce(F.col("p_retailprice") > 1000, F.lit(False))
    every, some = F.bool_and(read), F.bool_or(read)
    return t.part.groupBy("p_brand").agg(every.alias("fully_read"), (some & ~every).alias("reading"), (~some).alias("not_started"))


@query("""
WITH n AS (SELECT p_brand, min(CASE WHEN p_retailprice <= 1000 THEN p_size END) AS next_unread, min(p_size) AS first_no, max(p_size) AS last_no FROM part GROUP BY 1)
SELECT p_partkey, p_size = first_no AS is_first, p_size = last_no AS is_last, coalesce(p_size = next_unread AND p_retailprice <= 1000, false) AS is_next FROM part JOIN n USING (p_brand)
""")
def series_position(t: Tables):
    """First, last and next unread book of a series: one aggregate a series, joined back."""
    unread = F.col("p_retailprice") <= 1000
    n = t.part.groupBy("p_brand").agg(F.min(F.when(unread, F.col("p_size"))).alias("next_unread"), F.min("p_size").alias("first_no"), F.max("p_size").alias("last_no"))
    x = t.part.join(n, "p_brand")
    return x.select("p_partkey", (F.col("p_size") == F.col("first_no")).alias("is_first"), (F.col("p_size") == F.col("last_no")).alias("is_last"), F.coalesce((F.col("p_size") == F.col("next_unread")) & unread, F.lit(False)).alias("is_next"))


@query("""
WITH x AS (SELECT p_brand, min(p_partkey) AS first_key, count(*) AS members FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part) WHERE true GROUP BY 1),
r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part)
SELECT r.p_brand, r.p_partkey, members FROM r JOIN x USING (p_brand) WHERE k = 1
""")
def series_collapse(t: Tables):
    """A series shows as its lowest number, with its count."""
    x = t.part.groupBy("p_brand").agg(F.min(F.struct(F.col("p_size").isNull(), "p_size", "p_partkey")).alias("x"), F.count("*").alias("members"))
    return x.select("p_brand", "x.p_partkey", "members")


@query("""
SELECT p_brand, [n for n in range(1, 51) if NOT list_contains(own, n)] AS missing FROM (SELECT p_brand, list(DISTINCT CAST(p_size AS BIGINT)) AS own FROM part GROUP BY 1)
""")
def series_missing_numbers(t: Tables):
    own = t.part.groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("long")).alias("own"))
    return own.select("p_brand", F.array_except(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long")), "own").alias("missing"))


@query("""
SELECT p_brand, coalesce(bool_and(ok), true) AS in_order FROM (SELECT p_brand, p_retailprice >= lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ok FROM part) GROUP BY 1
""")
def series_in_order(t: Tables):
    """Whether values never fall along the numbers; a missing neighbour counts as in order."""
    before = F.lag("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    x = t.part.select("p_brand", F.coalesce(F.col("p_retailprice") >= before, F.lit(True)).alias("ok"))
    return x.groupBy("p_brand").agg(F.bool_and("ok").alias("in_order"))


@query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_type), 'steel') AND lower(p_brand) IN ('brand#11', 'brand#12', 'brand#13', 'brand#21') AND p_size < 30")
def content_restrictions(t: Tables):
    """Excluded words, an allow list and an age cap."""
    rows = t.part.select("p_partkey", F.split("p_type", " ").alias("words"), F.array("p_brand").alias("brands"), F.col("p_size").alias("age_rating"))
    return restricted(rows, {"words": ["STEEL"]}, {"brands": ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]}, [40, 30]).select("p_partkey")


@query("""
SELECT p_partkey, round((CASE WHEN length(trim(p_name)) > 0 THEN 3 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN contains(p_type, 'A') THEN 5 ELSE 0 END) * 100.0 / 10, 4) AS score FROM part
""")
def completeness_score(t: Tables):
    """Weighted share of present fields."""
    present = [(F.length(F.trim("p_name")) > 0, 3), (F.col("p_size") > 25, 2), (F.col("p_type").contains("A"), 5)]
    total = sum(w for _, w in present)
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in present), F.lit(0))
    return t.part.select("p_partkey", F.round(score * 100.0 / total, 4).alias("score"))
