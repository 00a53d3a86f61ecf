"""Dashboard rows, editions by author, series for feeds, completeness by the field table, releases for wanted books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.resolve import newest_per
from ..operators.search import COMPLETENESS, best_by_author, completeness, merged_results, release_score
from .browse import _BOOKS, books
from .registry import Tables, query

IN_PROGRESS = ("READING", "RE_READING", "PAUSED")
EBOOK = ("epub_progress", "pdf_progress", "cbx_progress", "koreader_progress", "kobo_progress")


@query(f"""
WITH {_BOOKS}, k AS (SELECT 'CONTINUE_READING' AS kind, id, last_read AS newest FROM b WHERE last_read IS NOT NULL AND read_status IN {IN_PROGRESS} AND coalesce({", ".join(EBOOK)}) IS NOT NULL
UNION ALL SELECT 'CONTINUE_LISTENING', id, last_read FROM b WHERE last_read IS NOT NULL AND read_status IN {IN_PROGRESS} AND audiobook_progress IS NOT NULL
UNION ALL SELECT 'RECENTLY_ADDED', id, added FROM b WHERE added IS NOT NULL)
SELECT kind, CAST(row_number() OVER w AS INTEGER) AS place, id FROM k WINDOW w AS (PARTITION BY kind ORDER BY newest DESC, id) QUALIFY row_number() OVER w <= 20
""")
def dashboard_rows(t: Tables):
    """The rows to continue reading and listening and the newest books: twenty each, newest first."""
    b = books(t)
    going = F.col("last_read").isNotNull() & F.col("read_status").isin(*IN_PROGRESS)
    kinds = {"CONTINUE_READING": (going & F.coalesce(*EBOOK).isNotNull(), "last_read"), "CONTINUE_LISTENING": (going & F.col("audiobook_progress").isNotNull(), "last_read"), "RECENTLY_ADDED": (F.col("added").isNotNull(), "added")}
    rows = [b.where(test).orderBy(F.desc(at), "id").limit(20).select(F.lit(kind).alias("kind"), "id", F.col(at).alias("at")) for kind, (test, at) in kinds.items()]
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at"), "id"))  # of twenty rows
    return reduce(lambda x, y: x.union(y), rows).select("kind", place.alias("place"), "id")


@query(f"""
WITH {_BOOKS}, o AS (SELECT o_custkey AS id, o_orderkey AS place, CASE WHEN o_orderkey % 3 > 0 THEN 'a' || o_orderkey END AS isbn13, CASE WHEN o_orderkey % 2 > 0 THEN 'b' || o_orderkey END AS isbn10, o_orderkey % 4 AS turn FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 2 > 0),
c AS (SELECT o.* FROM o JOIN b USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 15),
m AS (SELECT c.*, id % 5 = 0 AS nobody, turn = 0 OR turn = 1 AND id % 3 = 0 AS agrees FROM c),
r AS (SELECT id, count(*) AS n, bool_or(nobody) AS nobody, min(place) AS first, min(place) FILTER (agrees) AS agreed FROM m GROUP BY 1),
x AS (SELECT id, CASE WHEN n = 1 THEN 'only' WHEN nobody THEN 'first' WHEN agreed IS NOT NULL THEN 'author' ELSE 'none' END AS told, CASE WHEN n = 1 OR nobody THEN first ELSE agreed END AS place FROM r)
SELECT x.id AS query, isbn13, isbn10, told AS "by" FROM x LEFT JOIN m ON m.id = x.id AND m.place = x.place
""")
def editions_by_author(t: Tables):
    """For each book the edition that a title search means: fifteen candidates with an ISBN, told apart by their authors. Orders play the editions."""
    b, k = books(t).select("id", "authors"), F.col("o_orderkey")
    o = t.orders.where((k % 3 > 0) | (k % 2 > 0)).join(b, F.col("o_custkey") == F.col("id"))
    theirs = F.when(k % 4 == 0, F.array(F.upper(F.element_at("authors", 1)))).when(k % 4 == 1, F.array(F.concat(F.lit("Writer "), (F.col("id") % 7 + 1).cast("string")))).when(k % 4 == 2, F.array(F.lit("Nobody Else"))).otherwise(F.array().cast("array<string>"))
    found = o.select(F.col("id").alias("query"), k.alias("place"), F.when(k % 3 > 0, F.concat(F.lit("a"), k.cast("string"))).alias("isbn13"), F.when(k % 2 > 0, F.concat(F.lit("b"), k.cast("string"))).alias("isbn10"), theirs.alias("authors"))
    asked = b.select(F.col("id").alias("query"), F.when(F.col("id") % 5 > 0, F.col("authors")).alias("authors"))
    return best_by_author(newest_per(found, ["query"], [F.asc("place")], 15), asked)


@query(f"""
WITH {_BOOKS}, x AS (SELECT *, trim(series_name) AS s FROM b WHERE trim(series_name) <> ''), w AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY series_number NULLS LAST, id) AS k FROM x)
SELECT s AS series, count(*) AS books, arg_min(id, k) AS first_book, array_to_string(arg_min(categories, k), ',') AS genres, coalesce(nullif(arg_min(coalesce(language, ''), k), ''), 'en') AS language, arg_min(coalesce(publisher, ''), k) AS publisher,
  arg_min(published, k) FILTER (published IS NOT NULL) AS release_date, arg_min(narrator, k) FILTER (narrator IS NOT NULL AND narrator <> '') AS summary, array_to_string(list_sort(list_distinct(flatten(list(authors)))), ',') AS authors FROM w GROUP BY 1
""")
def feed_series(t: Tables):
    """A series as feeds show it: what its first book says, the first release date and summary that any book has, everybody who wrote it."""
    x = books(t).withColumn("s", F.trim("series_name")).where("s <> ''")
    at = F.struct(F.col("series_number").isNull(), "series_number", "id")
    first = lambda c: F.min_by(c, at)
    known = lambda c, test: F.min_by(c, F.when(test, at))
    s = x.groupBy(F.col("s").alias("series")).agg(
        F.count("*").alias("books"), first("id").alias("first_book"), F.array_join(first("categories"), ",").alias("genres"), F.coalesce(F.nullif(first(F.coalesce("language", F.lit(""))), F.lit("")), F.lit("en")).alias("language"),
        first(F.coalesce("publisher", F.lit(""))).alias("publisher"), known("published", F.col("published").isNotNull()).alias("release_date"), known("narrator", F.coalesce(F.col("narrator") != "", F.lit(False))).alias("summary"),
    )
    people = x.select(F.col("s").alias("series"), F.explode("authors").alias("a")).distinct().groupBy("series").agg(F.array_join(F.sort_array(F.collect_list("a")), ",").alias("authors"))
    return s.join(people, "series")


_SAYS = {
    "title": "trim(title) <> ''", "authors": "len(authors) > 0", "publisher": "trim(publisher) <> '' OR locked", "published": "published IS NOT NULL", "series_name": "trim(series_name) <> ''", "series_number": "series_number > 0", "language": "trim(language) <> '' OR locked",
    "page_count": "page_count > 0", "categories": "len(categories) > 0", **{c: f"{c} > 0" for c in ("amazon_rating", "amazon_review_count", "goodreads_rating", "goodreads_review_count", "hardcover_rating", "hardcover_review_count", "ranobedb_rating")},
}


@query(f"WITH {_BOOKS} SELECT id, round(({' + '.join(f'CASE WHEN {test} THEN {COMPLETENESS[name]} ELSE 0 END' for name, test in _SAYS.items())}) * 100.0 / {sum(COMPLETENESS.values())}, 6) AS score FROM b")
def metadata_scores(t: Tables):
    """Completeness of every book by the table of fields, locked ones counted as there."""
    b = books(t)
    locked = F.col("locked")
    return b.select("id", F.round(completeness(b, {"publisher": locked, "language": locked}), 6).alias("score"))


@query(f"""
WITH {_BOOKS}, w AS (SELECT id, title, p_brand AS author, list_filter(list_distinct(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: length(x) > 2) AS tt, 'brand' AS at, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS an FROM b),
r AS (SELECT l_orderkey, l_linenumber, l_partkey AS id, l_quantity AS q, l_orderkey % 3 AS cut, l_orderkey % 5 AS fmt, l_linenumber % 4 AS seeds, l_orderkey % 2 = 0 AS usenet FROM lineitem),
x AS (SELECT r.*, w.tt, w.an, lower(CASE WHEN cut = 0 THEN title ELSE split_part(title, ' ', 1) END || ' ' || CASE WHEN cut < 2 THEN author ELSE 'someone' END || '.' || ['epub', 'mobi', 'pdf', 'cbz', 'azw3'][fmt + 1] || CASE WHEN q > 45 THEN ' collection' ELSE '' END) AS raw FROM r JOIN w USING (id)),
n AS (SELECT *, regexp_replace(raw, '[^a-z0-9]+', ' ', 'g') AS name, list_filter(list_distinct(string_split(an, ' ')), lambda a: length(a) > 2) AS aa FROM x),
s AS (SELECT id, l_orderkey, l_linenumber, greatest(0, least(100, CASE WHEN len(tt) > 0 THEN CAST(floor(45.0 * len(list_filter(tt, lambda a: contains(name, a))) / len(tt)) AS INTEGER) ELSE 0 END + CASE WHEN len(aa) > 0 THEN CAST(floor(25.0 * len(list_filter(aa, lambda a: contains(name, a))) / len(aa)) AS INTEGER) ELSE 0 END
  + CASE WHEN contains(name, 'epub') THEN 15 WHEN contains(name, 'mobi') THEN 11 WHEN contains(name, 'pdf') THEN 7 ELSE 0 END + CASE WHEN usenet THEN 4 ELSE 8 + CASE WHEN seeds = 0 THEN -40 ELSE seeds END END - CASE WHEN q * 12 > 500 THEN 50 ELSE 0 END - CASE WHEN contains(name, 'collection') THEN 30 ELSE 0 END)) AS score FROM n)
SELECT id, l_orderkey, l_linenumber, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, l_orderkey, l_linenumber) <= 3
""")
def best_releases(t: Tables):
    """The three best releases for each wanted book. Lines play the releases."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    w = books(t).select("id", "title", F.col("p_brand").alias("author"))
    r = t.lineitem.join(w, F.col("l_partkey") == F.col("id"))
    format_ = F.element_at(F.array(*[F.lit(f) for f in ("epub", "mobi", "pdf", "cbz", "azw3")]), (k % 5 + 1).cast("int"))
    name = F.concat(F.when(k % 3 == 0, F.col("title")).otherwise(F.split_part("title", F.lit(" "), F.lit(1))), F.lit(" "), F.when(k % 3 < 2, F.col("author")).otherwise("someone"), F.lit("."), format_, F.when(F.col("l_quantity") > 45, " collection").otherwise(""))
    size = (F.col("l_quantity") * 12 * 1024 * 1024).cast("long")
    score = release_score(name, size, (line % 4).cast("int"), F.when(k % 2 == 0, "usenet").otherwise("torrent"), F.col("title"), F.col("author"), ("epub", "mobi", "pdf"))
    return newest_per(r.select("id", "l_orderkey", "l_linenumber", score.alias("score")), ["id"], [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@query(f"""
WITH {_BOOKS}, r AS (SELECT id AS query, l_orderkey * 10 + l_linenumber AS place, title AS asked, CASE l_linenumber % 4 WHEN 0 THEN title WHEN 1 THEN upper(title) WHEN 2 THEN title || ' - Illustrated' ELSE 'The ' || title END AS title, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS author,
  CASE WHEN l_orderkey % 3 = 0 THEN ' i' || (l_orderkey % 5) END AS isbn13, l_quantity > 25 AS described, l_orderkey % 2 = 0 AS shown, l_linenumber % 3 = 0 AS dated FROM lineitem JOIN b ON id = l_partkey),
k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')) AS q, CASE WHEN shown THEN 3 ELSE 0 END + CASE WHEN described THEN 2 ELSE 0 END + CASE WHEN isbn13 IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN author IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN dated THEN 1 ELSE 0 END AS richness FROM r),
m AS (SELECT *, coalesce('isbn:' || trim(isbn13), 'ta:' || t || '|' || coalesce(trim(regexp_replace(lower(author), '[^a-z0-9]+', ' ', 'g')), '')) AS key FROM k)
SELECT query, key, place, richness, richness + CASE WHEN t = q THEN 20 WHEN starts_with(t, q) THEN 12 WHEN contains(t, q) THEN 6 ELSE 0 END AS relevance FROM m QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY richness DESC, place) = 1
""")
def provider_results(t: Tables):
    """What several providers find for a book, one row a found book: the richest record, and how well it fits. Lines play the records."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    b = books(t).select("id", F.col("title").alias("asked"), "p_brand")
    title = F.when(line % 4 == 0, F.col("asked")).when(line % 4 == 1, F.upper("asked")).when(line % 4 == 2, F.concat("asked", F.lit(" - Illustrated"))).otherwise(F.concat(F.lit("The "), F.col("asked")))
    r = t.lineitem.join(b, F.col("l_partkey") == F.col("id")).select(
        F.col("id").alias("query"), (k * 10 + line).alias("place"), "asked", title.alias("title"), F.when(line % 2 == 0, F.col("p_brand")).alias("author"), F.when(k % 3 == 0, F.concat(F.lit(" i"), (k % 5).cast("string"))).alias("isbn13"),
        F.when(F.col("l_quantity") > 25, "text").alias("description"), F.when(k % 2 == 0, "url").alias("thumbnail"), F.when(line % 3 == 0, 2000).alias("year"),
    )
    return merged_results(r, F.col("asked")).select("query", "key", "place", "richness", "relevance")
