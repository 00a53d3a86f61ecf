"""Rules that name series, files and progress, and where the two dialects of the rule language differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.rules import PRESENCE, PROGRESS, Field, column_of, compile_rule, presence, reading_progress, series_states
from .browse import _BOOKS, books
from .registry import Tables, query
from .rules import NOW, _and, _leaf, _or


def _library(t: Tables):
    """Books with what rules can name beyond their own columns: series, files (lines), progress, presence of fields."""
    b = books(t).withColumn("status", F.when(F.col("read_status") != "LOST", F.col("read_status")))
    sizes = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).alias("size"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).alias("flag"), F.collect_set("l_quantity").alias("sizes"), F.collect_set("l_returnflag").alias("flags"))
    x = series_states(b, "id", F.col("series_name"), F.col("series_number"), F.col("status"), F.when(F.col("id") % 2 == 0, F.lit(45)).cast("long"))
    return x.join(sizes, "id", "left").withColumns({"presence": presence(b), "progress": reading_progress()})


def _schema() -> dict[str, Field]:
    c = F.col
    return {
        "seriesStatus": Field(c("series_status"), "series", c("lenient_status"), c("in_series")), "seriesGaps": Field(c("series_gaps"), "series", c("lenient_gaps"), c("in_series")),
        "seriesPosition": Field(c("series_position"), "series", None, c("in_series")), "metadataPresence": Field(c("presence"), "list"), "fileType": Field(c("flag"), "text", c("flags")), "fileSize": Field(c("size"), "number", c("sizes")),
        "readStatus": Field(F.nullif(c("status"), F.lit("UNREAD")), "text", None, c("status").isNotNull()), "readingProgress": Field(c("progress"), "number"), "addedOn": Field(c("added").cast("timestamp_ntz"), "instant"),
        "language": Field(c("language"), "text"), "shelf": Field(c("shelves"), "ids"),
    }


_PROGRESS = f"greatest({', '.join(f'coalesce({c}, 0)' for c in PROGRESS)})"
_SERIES = f"""
WITH {_BOOKS}, x AS (SELECT *, nullif(trim(series_name), '') AS s, CASE WHEN read_status <> 'LOST' THEN read_status END AS status, coalesce(read_status = 'READ', false) AS done FROM b),
g AS (SELECT s, bool_and(done) AS done_all, bool_or(done) AS done_some, bool_or(status IS NOT NULL AND NOT done) AS not_done, bool_or(coalesce(status = 'READING', false)) AS is_going, min(series_number) AS low, max(series_number) AS high, count(DISTINCT series_number) AS kinds, count(series_number) AS numbered,
  min(CASE WHEN NOT done THEN series_number END) AS next_no, max(CASE WHEN id % 2 = 0 THEN 45 END) AS most FROM x WHERE s IS NOT NULL GROUP BY 1),
f AS (SELECT l_partkey AS id, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity, l_returnflag)) AS size, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_quantity, l_returnflag)) AS flag, max(l_quantity) AS largest, bool_or(l_returnflag = 'R') AS some_r FROM lineitem GROUP BY 1),
j AS (SELECT x.*, g.done_all, g.done_some, g.not_done, g.is_going, g.low, g.high, g.kinds, g.numbered, g.next_no, g.most, f.size, f.flag, f.largest, f.some_r FROM x LEFT JOIN g USING (s) LEFT JOIN f USING (id))
"""


@query(_SERIES + """
SELECT id FROM j WHERE (coalesce(is_going OR (done_some AND NOT done_all), false) AND coalesce(high - low + 1 > kinds, false) AND NOT coalesce(series_number = high, false) AND s IS NOT NULL)
OR (coalesce(series_number = next_no AND NOT done, false)) OR (trim(publisher) <> '' AND trim(narrator) <> '' AND flag = 'R' AND """ + _PROGRESS + " > 10)")
def rule_series_fields(t: Tables):
    """One rule tree over series status, gaps and position, presence of fields, file type and progress."""
    rule = _or(
        _and(_leaf("seriesStatus", "equals", "reading"), _leaf("seriesGaps", "includes_any", ["any_gap"]), _leaf("seriesPosition", "not_equals", "last_in_series")), _leaf("seriesPosition", "equals", "next_unread"),
        _and(_leaf("metadataPresence", "includes_all", ["publisher", "narrator"]), _leaf("fileType", "equals", "r"), _leaf("readingProgress", "greater_than", 10)),
    )
    return _library(t).where(compile_rule(rule, _schema(), NOW)).select("id")


#: case -> (rule, the default dialect's condition, the lenient dialect's) in DuckDB's SQL over j.
CASES = {
    "empty group": (_or(), "false", "true"),
    "unreadable leaf": (_and(_leaf("nonsense", "equals", 1), _leaf("language", "equals", "eng")), "false", "language = 'eng'"),
    "instant comparison": (_and(_leaf("addedOn", "less_than", "2021-06-01")), "added < DATE '2021-06-01'", "true"),
    "file size": (_and(_leaf("fileSize", "greater_than", 48)), "size > 48", "largest > 48"),
    "file type": (_and(_leaf("fileType", "equals", "R")), "flag = 'R'", "some_r"),
    "status is empty": (_and(_leaf("readStatus", "is_empty")), "status IS NULL", "status IS NULL OR status = 'UNREAD'"),
    "not in a series": (_and(_leaf("seriesStatus", "not_equals", "reading")), "s IS NOT NULL AND NOT (is_going OR (done_some AND NOT done_all))", "NOT coalesce(is_going OR (done_some AND NOT done_all), false)"),
    "missing first": (_and(_leaf("seriesGaps", "equals", "missing_first")), "low > 1", "s IS NOT NULL AND (low > 1 OR low IS NULL)"),
    "fully read": (_and(_leaf("seriesStatus", "equals", "fully_read")), "done_all", "done_some AND NOT not_done"),
    "all of a scalar": (_and(_leaf("language", "includes_all", ["eng", "fre"])), "false", "language IN ('eng', 'fre')"),
    "not equal to null": (_and(_leaf("language", "not_equals", "eng")), "language IS DISTINCT FROM 'eng'", "language <> 'eng'"),
    "null without a text": (_and(_leaf("language", "does_not_contain", "e")), "NOT coalesce(contains(language, 'e'), false)", "NOT contains(language, 'e')"),
    "unknown beside true": (_or(_leaf("language", "not_equals", "eng"), _leaf("readingProgress", "greater_than", 40)), f"language IS DISTINCT FROM 'eng' OR {_PROGRESS} > 40", f"language <> 'eng' OR {_PROGRESS} > 40"),
    "null among others": (_and(_leaf("language", "excludes_all", ["eng", "fre"])), "NOT coalesce(language IN ('eng', 'fre'), false)", "language NOT IN ('eng', 'fre')"),
    "another status": (_and(_leaf("readStatus", "not_equals", "READ")), "NOT coalesce(status = 'READ', false)", "status IS NULL OR status <> 'READ'"),
    "shelf as text": (_and(_leaf("shelf", "contains", "S1")), "list_contains(shelves, 'S1')", "true"),
}


@query(_SERIES + " UNION ALL ".join(f"SELECT '{n}' AS difference, '{d}' AS dialect, id FROM j WHERE {c}" for n, (_, *both) in CASES.items() for d, c in zip(("default", "lenient"), both, strict=True)))
def rule_dialects(t: Tables):
    """Rows that each dialect selects, for every case in which they differ, in one pass."""
    tests = [F.when(compile_rule(rule, _schema(), NOW, d), F.struct(F.lit(n).alias("difference"), F.lit(d).alias("dialect"))) for n, (rule, *_) in CASES.items() for d in ("default", "lenient")]
    return _library(t).select("id", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("x.difference", "x.dialect", "id")


@query(f"""
WITH {_BOOKS}, p AS (SELECT l_partkey AS id, bool_or(l_suppkey % 3 = 0) AS mine, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT b.id, 'default' AS dialect FROM b WHERE NOT physical UNION ALL SELECT b.id, 'lenient' FROM b LEFT JOIN p USING (id) WHERE p.id IS NULL OR mine
""")
def visibility_dialects(t: Tables):
    """Default: books that are not deleted. Lenient: deleted ones too, but not those whose only progress is another user's."""
    b = books(t)
    p = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_suppkey") % 3 == 0).alias("mine"))
    own = b.join(p, "id", "left").where("mine is null or mine").select("id", F.lit("lenient").alias("dialect"))
    return reduce(lambda x, y: x.union(y), [b.where("not physical").select("id", F.lit("default").alias("dialect")), own])


#: Of the presence names those that the books have: name -> its test in DuckDB's SQL.
_LISTS = ("authors", "categories", "moods", "tags", "characters", "teams", "locations", "penciller", "editor")
_TEXTS = ("title", "publisher", "language", "series_name", "content_rating", "narrator")
_OTHERS = ("personal_rating", "page_count", "series_number", "age_rating", "published", "amazon_rating", "goodreads_rating", "hardcover_rating", "ranobedb_rating", "amazon_review_count", "goodreads_review_count", "hardcover_review_count")
_THERE = {n: f"len({c}) > 0" if c in _LISTS else f"trim({c}) <> ''" if c in _TEXTS else f"{c} IS NOT NULL" for n in PRESENCE if (c := column_of(n)) in (*_LISTS, *_TEXTS, *_OTHERS)}


@query(f"WITH {_BOOKS} " + " UNION ALL ".join(f"SELECT '{n}' AS name, id FROM b WHERE {test}" for n, test in _THERE.items()))
def present_fields(t: Tables):
    """Which fields every book has, by the names that presence rules know."""
    b = books(t)
    return b.select(F.explode(presence(b)).alias("name"), "id")
