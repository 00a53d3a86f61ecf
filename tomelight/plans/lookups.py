"""Resumable pages, chunks, ranked title search and recommendations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging, search
from ..operators.resolve import hashed_entries, hashed_weights, shared_folder, top_similar_classes, weighted_features, widened, written
from ..operators.sets import spread
from .browse import _BOOKS, _RANK, books
from .registry import Tables, query

_PAIR = "o AS (SELECT id, read_status, page_count FROM b WHERE id % 4 <> 0), n AS (SELECT id, CASE WHEN id % 10 = 1 THEN 'READ' ELSE read_status END AS read_status, CASE WHEN id % 12 = 5 THEN NULL ELSE page_count END AS page_count FROM b WHERE id % 9 <> 0)"


def _snapshots(t: Tables):
    b = books(t).select("id", "read_status", "page_count")
    new = b.where("id % 9 <> 0").select("id", F.when(F.col("id") % 10 == 1, "READ").otherwise(F.col("read_status")).alias("read_status"), F.when(F.col("id") % 12 != 5, F.col("page_count")).alias("page_count"))
    return b.where("id % 4 <> 0"), new


_DIFFERENCE = f"WITH {_BOOKS}, {_PAIR}, d AS (SELECT CASE WHEN o.id IS NULL THEN 0 WHEN n.id IS NULL THEN 2 ELSE 1 END AS told, coalesce(n.id, o.id) AS id FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.read_status IS DISTINCT FROM n.read_status OR o.page_count IS DISTINCT FROM n.page_count)"


@query(_DIFFERENCE + """ SELECT told, id, ['added', 'changed', 'removed'][told + 1] AS change, '{"over":{"from":"a","to":"b"},"after":[' || told || ',' || id || ']}' AS cursor FROM d WHERE told > 1 OR told = 1 AND id > 90 ORDER BY told, id LIMIT 5""")
def sync_page(t: Tables):
    """The page of five changes after a cursor (changed, book 90), each with the cursor that resumes after it."""
    old, new = _snapshots(t)
    changes = paging.difference(old, new, ["id"], ["read_status", "page_count"])
    return paging.page_after(changes, ["told", "id"], 5, paging.cursor({"from": "a", "to": "b"}, [1, 90]))


@query(_DIFFERENCE + " SELECT told, id, (row_number() OVER (ORDER BY told, id) - 1) // 5 AS page FROM d")
def sync_pages(t: Tables):
    """Every change with the number of its page of five."""
    old, new = _snapshots(t)
    changes = paging.difference(old, new, ["id"], ["read_status", "page_count"]).select("told", "id")
    return paging.ranked(changes, ["told", "id"]).select("told", "id", F.floor(F.col("rank") / 5).alias("page"))


@query(f"WITH {_BOOKS}, r AS (SELECT id, title, (row_number() OVER (ORDER BY id) - 1) // 500 AS chunk FROM b) SELECT chunk, min(id) AS first, max(id) AS last, count(*) AS n, md5(string_agg(title, '|' ORDER BY id)) AS content FROM r GROUP BY 1")
def book_chunks(t: Tables):
    """All books in id order as chunks of 500, with a digest of what each holds."""
    found = paging.chunks(books(t).select("id", "title"), ["id"])
    return found.select("chunk", "first", "last", "n", F.md5(F.concat_ws("|", F.transform("rows", lambda r: r["title"]))).alias("content"))


@query(f"WITH {_BOOKS}, i AS (SELECT c_custkey AS reader, unnest([c_custkey * 7 % 190 + 1, c_custkey % 90 + 1, c_custkey * 7 % 190 + 1]) AS id, unnest([0, 1, 2]) AS place FROM customer) SELECT reader, place, id, title FROM i JOIN b USING (id)")
def listed_books(t: Tables):
    """Each reader's list of ids as books, in the list's order: an id listed twice comes twice, one without a book is left out."""
    k = F.col("c_custkey")
    listed = t.customer.select(k.alias("reader"), F.array(k * 7 % 190 + 1, k % 90 + 1, k * 7 % 190 + 1).alias("ids"))
    return listed.select("reader", F.posexplode("ids").alias("place", "id")).join(books(t).select("id", "title"), "id").select("reader", "place", "id", "title")


@query(f"""
WITH {_BOOKS}, w AS (SELECT id, language, unnest(list_distinct(string_split(title, ' '))) AS token FROM b), d AS (SELECT token, count(*) AS df FROM w GROUP BY 1),
s AS (SELECT id, any_value(language) AS language, list_sort(list(token)) AS matched, round(sum(ln((SELECT count(*) FROM b) / df)), 9) AS score FROM w JOIN d USING (token) WHERE token IN ('ring', 'small', '12', 'absent') GROUP BY 1)
SELECT id, matched, round(score, 6) AS score FROM s ORDER BY s.score DESC, {_RANK}, id LIMIT 10
""")
def title_search(t: Tables):
    """The ten best titles for a text by their rare matched words, through an index in buckets of tokens."""
    rows = books(t).select("id", "title", "language")
    path = shared_folder(t.spark, "titles")
    search.build(rows, path, keep=("language",))
    rank = F.when(F.col("language") == "eng", 0).when(F.col("language").isNull(), 1).otherwise(2)
    return search.lookup(t.spark, path, "Ring SMALL 12 absent", [rank]).select("id", "matched", F.round("score", 6).alias("score"))


def book_features(rows):
    """What recommendations compare: title words 3, authors 5, categories 4, series 6, publisher 2."""
    alone = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    return weighted_features([("title", F.col("title"), 3, 20), ("author", F.col("authors"), 5, None), ("category", F.col("categories"), 4, None), ("series", alone("series_name"), 6, None), ("publisher", alone("publisher"), 2, None)])


_VECTORS = f"""
WITH {_BOOKS}, f AS (
SELECT id, 'title_' || w AS k, 3 AS g FROM (SELECT id, unnest([x FOR x IN string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF length(x) > 3][1:20]) AS w FROM b)
UNION ALL SELECT id, 'author_' || a, 5 FROM (SELECT id, unnest(list_distinct([lower(x) FOR x IN authors])) AS a FROM b)
UNION ALL SELECT id, 'category_' || a, 4 FROM (SELECT id, unnest(list_distinct([lower(x) FOR x IN categories])) AS a FROM b)
UNION ALL SELECT id, 'series_' || lower(series_name), 6 FROM b WHERE series_name IS NOT NULL
UNION ALL SELECT id, 'publisher_' || lower(publisher), 2 FROM b WHERE publisher IS NOT NULL),
h AS (SELECT DISTINCT k, list_reduce([CAST(0 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(k, '')], lambda h, x: (h * 31 + x) & 4294967295) AS u FROM f),
v AS (SELECT id, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 128 AS place, sum(g) AS w FROM f JOIN h USING (k) GROUP BY 1, 2)
"""


@query(_VECTORS + "SELECT id, place, CAST(w AS DOUBLE) AS weight FROM v")
def feature_places(t: Tables):
    """Each book's hashed features: the places that hold a weight."""
    b = books(t)
    found = hashed_weights(b, "id", book_features(b))
    return found.select("id", F.posexplode("vector").alias("place", "weight")).where("weight <> 0")


@query(_VECTORS + """, n AS (SELECT id, sum(w * w) AS q FROM v GROUP BY 1), d AS (SELECT a.id AS x, c.id AS y, sum(a.w * c.w) AS dot FROM v a JOIN v c ON a.place = c.place AND a.id <> c.id GROUP BY 1, 2),
s AS (SELECT x AS query, y AS other, dot / sqrt(CAST(n.q * m.q AS DOUBLE)) AS score FROM d JOIN n ON n.id = x JOIN n m ON m.id = y JOIN b p ON p.id = x JOIN b r ON r.id = y WHERE p.series_name IS NULL OR r.series_name IS NULL OR lower(p.series_name) <> lower(r.series_name))
SELECT query, other, round(score, 6) AS score FROM s WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, other) <= 25
""")
def recommendations_all(t: Tables):
    """For every book the 25 most similar ones above 0.1 of other series, by hashed weighted features."""
    b = spread(books(t).select("id", "title", "authors", "categories", "series_name", "publisher"), "id")
    says = written(hashed_entries(b, "id", book_features(b)).join(b.select("id", F.lower("series_name").alias("series")), "id"))
    return top_similar_classes(says, "id", "entries", apart="series", wide=widened).select("query", "other", F.round("score", 6).alias("score"))
