"""Browsing part as a catalogue of books with every field: 28 facets, 28 sort orders, pages, feeds, lookups, list views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import search_key
from ..operators.catalogue import AGES, FILE_SIZE, MATCH_SCORE, PAGE_COUNT, PROGRESS, RATING, ROLES, STATUSES, TOP, book_facets, browse, ordered, ranks, sort_keys
from ..operators.facets import facet_counts
from ..operators.resolve import written
from .registry import Tables, query

#: A book's fields over part, in SQL that Spark and DuckDB read alike.
SCALARS = {
    "id": "p_partkey",
    "title": "p_name || ' ' || (p_partkey % 37)",
    "series_name": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '  ' ELSE ' ' || p_brand || ' ' END",
    "series_number": "CASE WHEN p_partkey % 9 > 0 THEN p_size END",
    "book_type": "CASE p_partkey % 4 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'PDF' WHEN 2 THEN 'CBX' END",
    "physical": "p_partkey % 11 = 0",
    "read_status": "CASE p_partkey % 6 WHEN 0 THEN 'READ' WHEN 1 THEN 'READING' WHEN 2 THEN 'ABANDONED' WHEN 3 THEN 'LOST' WHEN 4 THEN 'UNREAD' END",
    "personal_rating": "CASE WHEN p_partkey % 3 > 0 THEN p_size % 12 END",
    "publisher": "CASE p_size % 4 WHEN 0 THEN '' ELSE 'House ' || (p_size % 13) END",
    "match_score": "CASE WHEN p_partkey % 8 > 0 THEN CAST(p_partkey % 101 AS DOUBLE) END",
    "library": "'Library ' || (p_partkey % 3)",
    "published": "CASE WHEN p_partkey % 10 > 0 THEN DATE '1990-01-01' + CAST(p_partkey % 9000 AS INT) END",
    "added": "CASE WHEN p_partkey % 13 > 0 THEN DATE '2020-01-01' + CAST(p_partkey * 7 % 1500 AS INT) END",
    "finished": "CASE WHEN p_partkey % 6 = 0 THEN DATE '2021-01-01' + CAST(p_partkey * 11 % 1400 AS INT) END",
    "last_read": "CASE WHEN p_partkey % 7 > 2 THEN DATE '2022-01-01' + CAST(p_partkey * 3 % 800 AS INT) END",
    "file_size_kb": "p_partkey * 7919 % 6000000",
    "file_name": "p_brand || '.epub'",
    "file_path": "'shelf' || (p_partkey % 20) || '/' || p_brand",
    "amazon_rating": "CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 51) / 10.0 END",
    "goodreads_rating": "CASE WHEN p_partkey % 5 > 1 THEN (p_size % 51) / 10.0 END",
    "hardcover_rating": "CASE WHEN p_partkey % 7 = 3 THEN 4.5 END",
    "ranobedb_rating": "CASE WHEN p_partkey % 17 = 3 THEN p_size % 6 END",
    "rating": "p_size % 6",
    "review_count": "p_partkey % 300",
    "amazon_review_count": "p_partkey * 31 % 5000",
    "goodreads_review_count": "p_partkey * 17 % 20000",
    "hardcover_review_count": "p_size * 3",
    "language": "CASE p_partkey % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' WHEN 2 THEN '' WHEN 3 THEN 'ger' END",
    "page_count": "CASE WHEN p_partkey % 6 > 0 THEN p_size * 25 END",
    "age_rating": "CASE WHEN p_partkey % 3 = 0 THEN p_size % 22 END",
    "content_rating": "CASE WHEN p_partkey % 2 = 0 THEN 'TEEN' END",
    "narrator": "CASE WHEN p_partkey % 9 = 4 THEN 'Voice ' || (p_partkey % 4) END",
    "verification": "CASE WHEN p_size % 2 = 0 THEN 'LOCAL' END",
    "locked": "CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END",
    "epub_progress": "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size * 2 AS DOUBLE) END",
    "pdf_progress": "CASE WHEN p_partkey % 5 = 1 THEN 0.5 * p_size END",
    "cbx_progress": "CASE WHEN p_partkey % 5 = 2 THEN 100.0 END",
    "audiobook_progress": "CASE WHEN p_partkey % 10 = 3 THEN 0.0 END",
    "koreader_progress": "CASE WHEN p_partkey % 10 = 3 THEN 9.0 END",
    "kobo_progress": "CASE WHEN p_partkey % 20 = 8 THEN 33.0 END",
}
LISTS = {
    "authors": ["p_brand", "CASE WHEN p_partkey % 3 = 0 THEN 'Writer ' || (p_partkey % 7) END"],
    "categories": ["lower(p_type)", "CASE WHEN p_size > 25 THEN 'long' END", "CASE WHEN p_size % 10 = 0 THEN 'history' END"],
    "shelves": ["CASE WHEN p_partkey % 4 = 0 THEN 'S' || (p_size % 5) END"],
    "tags": ["CASE WHEN p_partkey % 2 = 0 THEN 't' || (p_size % 7) END"],
    "moods": ["CASE WHEN p_partkey % 5 = 2 THEN 'dark' END", "CASE WHEN p_partkey % 3 = 1 THEN 'light' END"],
    "characters": ["CASE WHEN p_partkey % 12 = 1 THEN 'C' || (p_size % 4) END"],
    "teams": ["CASE WHEN p_partkey % 12 = 1 THEN 'T' || (p_size % 3) END"],
    "locations": ["CASE WHEN p_partkey % 12 = 2 THEN 'L' || (p_size % 3) END"],
    "penciller": ["CASE WHEN p_partkey % 12 = 1 THEN 'Ann' END"],
    "editor": ["CASE WHEN p_partkey % 12 < 2 THEN 'Bob' END"],
}
_BOOKS = "b AS (SELECT " + ", ".join([f"{e} AS {n}" for n, e in SCALARS.items()] + [f"list_filter([{', '.join(es)}], lambda x: x IS NOT NULL) AS {n}" for n, es in LISTS.items()]) + ", p_brand FROM part)"


def books(t: Tables):
    """part as books with all fields."""
    lists = {n: F.array_compact(F.array(*[F.expr(e) for e in es])) for n, es in LISTS.items()}
    none = {r: F.array().cast("array<string>") for r in ROLES if r not in LISTS}
    return t.part.select(*[F.expr(e).alias(n) for n, e in SCALARS.items()], *[c.alias(n) for n, c in (lists | none).items()], "p_brand")


def _case(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {low} {'' if high == TOP else f'AND {value} < {high}'} THEN '{label}'" for label, low, high in bands) + " END"


_ONE = {
    "series": "nullif(trim(series_name), '')", "bookType": "CASE WHEN physical THEN 'PHYSICAL' ELSE book_type END", "readStatus": "CASE WHEN read_status IN " + str(STATUSES) + " THEN read_status ELSE 'UNSET' END",
    "personalRating": "CASE WHEN personal_rating BETWEEN 1 AND 10 THEN CAST(personal_rating AS VARCHAR) END", "publisher": "nullif(publisher, '')", "matchScore": _case("(CASE WHEN match_score > 1 THEN match_score / 100 ELSE match_score END)", MATCH_SCORE),
    "library": "library", "shelfStatus": "CASE WHEN len(shelves) > 0 THEN 'shelved' ELSE 'unshelved' END", "publishedDate": "CAST(year(published) AS VARCHAR)", "fileSize": _case("file_size_kb", FILE_SIZE), "amazonRating": _case("amazon_rating", RATING),
    "goodreadsRating": _case("goodreads_rating", RATING), "hardcoverRating": _case("hardcover_rating", RATING), "language": "nullif(language, '')", "pageCount": _case("page_count", PAGE_COUNT),
    "ageRating": "CASE age_rating " + " ".join(f"WHEN {a} THEN '{n}'" for a, n in AGES.items()) + " END", "contentRating": "content_rating", "narrator": "narrator", "verificationStatus": "verification",
}
_MANY = {"author": "authors", "category": "categories", "shelf": "shelves", "tag": "tags", "mood": "moods", "comicCharacter": "characters", "comicTeam": "teams", "comicLocation": "locations", "comicCreator": "list_concat([x || ':penciller' FOR x IN penciller], [x || ':editor' FOR x IN editor])"}
ACTIVE = {"readStatus": ["READ", "UNSET"], "category": ["history", "long"], "fileSize": ["10–50 MB", "1–2 GB", "50–100 MB"]}


def _holds(name: str) -> str:
    wanted = "[" + ", ".join(f"'{v}'" for v in ACTIVE[name]) + "]"
    own = _MANY[name] if name in _MANY else f"[{_ONE[name]}]"
    return f"coalesce(list_has_any({own}, {wanted}), false)"


def _facet_sql(name: str) -> str:
    others = " AND ".join(_holds(n) for n in ACTIVE if n != name)
    values = f"unnest(list_distinct({_MANY[name]}))" if name in _MANY else _ONE[name]
    return f"SELECT '{name}' AS facet, v AS value, count(*) AS n FROM (SELECT {values} AS v FROM b WHERE {others}) WHERE v IS NOT NULL GROUP BY 2"


@query(f"WITH {_BOOKS}, c AS (" + " UNION ALL ".join(_facet_sql(n) for n in (*_ONE, *_MANY)) + ") SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 100")
def all_facets(t: Tables):
    """Counts of all 28 facets in one pass; each respects the filters of the others."""
    return facet_counts(books(t), book_facets(), ACTIVE)


def _natural(text: str) -> str:
    number = rf"regexp_extract({text}, '(\d+)', 1)"
    return rf"CASE WHEN {number} = '' THEN {text} ELSE regexp_replace({text}, '\d+', lpad({number}, 20, '0')) END"


_SORTS = {
    "title": _natural("lower(title)"), "author": None, "authorSurnameVorname": None, "publishedDate": "published", "publisher": _natural("nullif(publisher, '')"), "locked": "coalesce(locked, false)", "lastReadTime": "last_read", "addedOn": "added",
    "fileName": _natural("lower(file_name)"), "filePath": None, "random": "md5(CAST(id AS VARCHAR))", "seriesName": _natural("nullif(lower(series_name), '')"), "seriesNumber": "series_number", "readStatus": "nullif(list_position(" + str(list(STATUSES)) + ", read_status), 0)",
    "dateFinished": "finished", "readingProgress": "coalesce(" + ", ".join(f"{p}_progress" for p in PROGRESS) + ")",
} | {n: f"nullif({c}, 0)" for n, c in (("pageCount", "page_count"), ("rating", "rating"), ("personalRating", "personal_rating"), ("reviewCount", "review_count"), ("amazonRating", "amazon_rating"), ("amazonReviewCount", "amazon_review_count"), ("goodreadsRating", "goodreads_rating"), ("goodreadsReviewCount", "goodreads_review_count"), ("hardcoverRating", "hardcover_rating"), ("hardcoverReviewCount", "hardcover_review_count"), ("ranobedbRating", "ranobedb_rating"), ("fileSizeKb", "file_size_kb"))}
_PAD = r"replace(replace(lower(p_brand), '#', '#' || repeat('0', 20 - length(regexp_extract(p_brand, '(\d+)', 1)))), ' ', ' ')"
_WRITER = "CASE WHEN id % 3 = 0 THEN {0} || lpad(CAST(id % 7 AS VARCHAR), 20, '0'){1} ELSE '' END"
_SORTS["author"] = _PAD + " || " + _WRITER.format("', writer '", "")
_SORTS["authorSurnameVorname"] = _PAD + " || CASE WHEN id % 3 = 0 THEN ', ' || lpad(CAST(id % 7 AS VARCHAR), 20, '0') || ', writer' ELSE '' END"
_SORTS["filePath"] = "'shelf' || lpad(CAST(id % 20 AS VARCHAR), 20, '0') || '/' || " + _PAD


@query(
    f"WITH {_BOOKS} "
    + " UNION ALL ".join(f"SELECT '{n}{d}' AS sorted_by, place, id FROM (SELECT id, row_number() OVER (ORDER BY {e} {d} NULLS {'FIRST' if d == 'DESC' else 'LAST'}, id) AS place FROM b) WHERE place <= 20" for n, e in _SORTS.items() for d in ("ASC", "DESC"))
)
def all_sorts(t: Tables):
    """The first 20 books by each of the 28 sort fields, rising and falling."""
    keys = sort_keys()
    rows = written(books(t).select("id", *[c.alias(n) for n, c in keys.items()]))  # 56 orders read the keys, not the books
    order = lambda n, falling: [F.col(n).desc_nulls_first() if falling else F.col(n).asc_nulls_last(), F.col("id")]
    return ranks(rows, {f"{n}{'DESC' if falling else 'ASC'}": order(n, falling) for n in keys for falling in (False, True)}, 20)


@query(f"""
WITH {_BOOKS}, s AS (SELECT * FROM b WHERE (contains(lower(title), 'ing') OR contains(lower(coalesce(series_name, '')), 'ing')) AND {_holds("readStatus")} AND {_holds("category")}),
k AS (SELECT *, coalesce('s:' || nullif(trim(series_name), ''), 'b:' || id) AS k FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY k) AS members FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY series_number NULLS LAST, id) = 1)
SELECT id, members, count(*) OVER () AS total FROM c ORDER BY added DESC NULLS FIRST, {_SORTS["title"]}, id LIMIT 30 OFFSET 1
""")
def browse_page(t: Tables):
    """Search, facets, one book a series, two sort keys, a page with the total."""
    active = {n: ACTIVE[n] for n in ("readStatus", "category")}
    rows = browse(books(t), "ING", active, collapse=True, sorts=[("addedOn", True), ("title", False)], page=0, size=31)
    found = rows.orderBy(*ordered(rows, [("addedOn", True), ("title", False)])).offset(1)
    return found.select("id", "members", "total")


_FEED = {"RECENT": "added DESC NULLS LAST", "TITLE_ASC": "lower(title)", "TITLE_DESC": "lower(title) DESC", "AUTHOR_ASC": "lower(p_brand)", "AUTHOR_DESC": "lower(p_brand) DESC", "SERIES_ASC": "trim(series_name) NULLS LAST, series_number NULLS LAST", "SERIES_DESC": "trim(series_name) DESC NULLS LAST, series_number NULLS LAST", "RATING_ASC": "stars NULLS LAST", "RATING_DESC": "stars DESC NULLS LAST"}
_STARS = "CASE WHEN coalesce(amazon_rating, 0) > 0 OR coalesce(goodreads_rating, 0) > 0 OR coalesce(hardcover_rating, 0) > 0 THEN (greatest(coalesce(amazon_rating, 0), 0) + greatest(coalesce(goodreads_rating, 0), 0) + greatest(coalesce(hardcover_rating, 0), 0)) / (CASE WHEN amazon_rating > 0 THEN 1 ELSE 0 END + CASE WHEN goodreads_rating > 0 THEN 1 ELSE 0 END + CASE WHEN hardcover_rating > 0 THEN 1 ELSE 0 END) END"


@query(
    f"WITH {_BOOKS}, x AS (SELECT *, round({_STARS}, 6) AS stars FROM b), p AS (SELECT * FROM x ORDER BY added DESC NULLS LAST, id LIMIT 50) "
    + " UNION ALL ".join(f"SELECT '{scope}{n}' AS sorted_by, place, id FROM (SELECT id, row_number() OVER (ORDER BY {o}, id) AS place FROM {table}) WHERE place <= 25" for scope, table in (("", "x"), ("page ", "p")) for n, o in _FEED.items())
)
def feed_sorts(t: Tables):
    """Nine feed orders over all books, and within the newest page only; a rating is the mean of the positive ones of three sources."""
    x = books(t).withColumn("stars", F.round(F.expr(_STARS), 6))
    low, author, series, number = F.lower("title"), F.lower("p_brand"), F.trim("series_name"), F.col("series_number").asc_nulls_last()
    orders = {
        "RECENT": [F.col("added").desc_nulls_last()], "TITLE_ASC": [low], "TITLE_DESC": [low.desc()], "AUTHOR_ASC": [author], "AUTHOR_DESC": [author.desc()], "SERIES_ASC": [series.asc_nulls_last(), number], "SERIES_DESC": [series.desc_nulls_last(), number],
        "RATING_ASC": [F.col("stars").asc_nulls_last()], "RATING_DESC": [F.col("stars").desc_nulls_last()],
    }
    orders = {n: [*o, F.col("id")] for n, o in orders.items()}
    page = x.orderBy(F.col("added").desc_nulls_last(), "id").limit(50)
    return ranks(x, orders, 25).union(ranks(page, {f"page {n}": o for n, o in orders.items()}, 25))


_AUTHORS = f"""
WITH {_BOOKS}, a AS (SELECT p_brand AS name, count(*) AS books, max(added) AS latest, max(last_read) AS read, round(avg(CASE WHEN personal_rating > 0 THEN personal_rating END), 6) AS stars,
  round(avg(coalesce({", ".join(f"{p}_progress" for p in PROGRESS)}, 0)), 6) AS progress, bool_or(read_status = 'READ') AS some_read, bool_or(list_contains(categories, 'history')) AS historic, min(library) AS library FROM b GROUP BY 1),
y AS (SELECT *, length(name) % 2 = 0 AS matched, contains(name, '1') AS photo FROM a)
"""
_BY = {"name": "name", "book-count": "books {d}, name", "matched": "matched {d}, name", "recently-added": "latest {d} NULLS LAST, name", "recently-read": "read {d} NULLS LAST, name", "reading-progress": "progress {d}, name", "avg-rating": "stars {d} NULLS LAST, name", "photo": "photo {d}, name", "series-count": "some_read {d}, name"}


def _authors(t: Tables):
    x = books(t)
    progress = F.coalesce(*[F.col(f"{p}_progress") for p in PROGRESS], F.lit(0.0))
    a = x.groupBy(F.col("p_brand").alias("name")).agg(
        F.count("*").alias("books"), F.max("added").alias("latest"), F.max("last_read").alias("read"), F.round(F.avg(F.when(F.col("personal_rating") > 0, F.col("personal_rating"))), 6).alias("stars"),
        F.round(F.avg(progress), 6).alias("progress"), F.bool_or(F.coalesce(F.col("read_status") == "READ", F.lit(False))).alias("some_read"), F.bool_or(F.array_contains("categories", "history")).alias("historic"), F.min("library").alias("library"),
    )
    return a.withColumns({"matched": F.length("name") % 2 == 0, "photo": F.col("name").contains("1")})


@query(
    _AUTHORS
    + " UNION ALL ".join(f"SELECT '{n} {d}' AS sorted_by, place, name AS id FROM (SELECT name, row_number() OVER (ORDER BY {(o if '{d}' in o else o + ' {d}').format(d=d)}) AS place FROM y) WHERE place <= 10" for n, o in _BY.items() for d in ("ASC", "DESC"))
)
def author_sorts(t: Tables):
    """Nine orders of authors, rising and falling; the name decides, and missing values come last both ways."""
    column = {"name": "name", "book-count": "books", "matched": "matched", "recently-added": "latest", "recently-read": "read", "reading-progress": "progress", "avg-rating": "stars", "photo": "photo", "series-count": "some_read"}
    key = lambda c, d: F.col(c).asc_nulls_last() if d == "ASC" else F.col(c).desc_nulls_last()
    orders = {f"{n} {d}": [key(c, d), F.col("name")] for n, c in column.items() for d in ("ASC", "DESC")}
    return ranks(_authors(t).withColumn("id", F.col("name")), orders, 10)


@query(_AUTHORS + "SELECT name, books FROM y WHERE matched AND some_read AND books BETWEEN 2 AND 100000 AND historic AND library = 'Library 0'")
def author_filters(t: Tables):
    """Authors by match, read status, count band, genre and library at once."""
    return _authors(t).where("matched and some_read and books between 2 and 100000 and historic and library = 'Library 0'").select("name", "books")


@query(f"WITH {_BOOKS} SELECT id, series_number, count(*) OVER () AS total FROM b WHERE trim(series_name) = 'Brand#11' ORDER BY series_number NULLS LAST, id LIMIT 20 OFFSET 5")
def series_books(t: Tables):
    """A page of a series by its exact trimmed name, with the total."""
    rows = books(t).where(F.trim("series_name") == "Brand#11").select("id", "series_number")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.col("series_number").asc_nulls_last(), "id").offset(5).limit(20).join(F.broadcast(total))


@query(f"WITH {_BOOKS} SELECT id FROM b WHERE library = 'Library 1' AND (list_contains(shelves, 'S1') OR read_status = 'READING') AND NOT coalesce(physical, false)")
def scoped_books(t: Tables):
    """Books of a library that are on a shelf or match a shelf's rule."""
    return books(t).where((F.col("library") == "Library 1") & (F.array_contains("shelves", "S1") | F.coalesce(F.col("read_status") == "READING", F.lit(False))) & ~F.coalesce("physical", F.lit(False))).select("id")


def optional(rows, **wanted):
    """Rows that equal every given value; a value of None asks for nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def optional_filters(t: Tables):
    return optional(t.orders, o_orderstatus="F", o_orderpriority="2-HIGH", o_custkey=None).select("o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def exists_flags(t: Tables):
    """Whether something exists, a flag a row: a semi-join's answer kept as a column."""
    some = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("pending", F.lit(True))
    return t.customer.join(some, "c_custkey", "left").select("c_custkey", F.coalesce("pending", F.lit(False)).alias("pending"))


@query(f"WITH {_BOOKS} SELECT id FROM b WHERE (last_read IS NOT NULL AND (finished IS NULL OR last_read > finished)) OR (read_status = 'READ' AND added IS NULL) OR (read_status IN ('READING', 'ABANDONED') AND finished IS NULL AND last_read > added)")
def sync_needed(t: Tables):
    """Three reasons to send a book's state: read since the last sync, finished but never sent, or status newer than what was sent."""
    since = F.col("last_read").isNotNull() & (F.col("finished").isNull() | (F.col("last_read") > F.col("finished")))
    never = (F.col("read_status") == "READ") & F.col("added").isNull()
    newer = F.col("read_status").isin("READING", "ABANDONED") & F.col("finished").isNull() & (F.col("last_read") > F.col("added"))
    return books(t).where(F.coalesce(since, F.lit(False)) | F.coalesce(never, F.lit(False)) | F.coalesce(newer, F.lit(False))).select("id")


@query(f"WITH {_BOOKS} SELECT id, title, coalesce(locked AND physical, false) AS all_locked FROM b")
def list_view(t: Tables):
    """A slim row a book; all_locked: there is a lock and no lock is off or unknown, taken before the locks are dropped."""
    locks = F.array("locked", "physical")
    return books(t).select("id", "title", F.coalesce(F.forall(locks, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).alias("all_locked"))


@query("""
SELECT l_orderkey, arg_min(k, (coalesce(list_position(['R', 'N'], l_returnflag), 99), k)) AS primary_file FROM (SELECT *, l_linenumber * 1000000 + l_partkey AS k FROM lineitem) GROUP BY 1
""")
def primary_files(t: Tables):
    """A book's first file of the best format by the library's priority, else the lowest id."""
    key = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("R"), F.lit("N")), F.col("l_returnflag")), F.lit(0)), F.lit(99))
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by(key, F.struct(rank.alias("r"), key.alias("k"))).alias("primary_file"))


@query(f"""
WITH {_BOOKS}, f AS (SELECT l_partkey AS id, max(l_quantity) AS progress, max(CAST(l_shipdate AS DATE)) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT b.id, round(coalesce(f.progress, b.epub_progress, b.pdf_progress), 1) AS progress, greatest(coalesce(f.at, b.last_read), coalesce(b.last_read, f.at)) AS last_read FROM b LEFT JOIN f USING (id)
""")
def progress_enriched(t: Tables):
    """Progress of a file before that of the book, and the later of both reading times."""
    f = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("progress"), F.max(F.to_date("l_shipdate")).alias("at"))
    x = books(t).join(f, "id", "left")
    return x.select("id", F.round(F.coalesce("progress", "epub_progress", "pdf_progress"), 1).alias("progress"), F.greatest("at", "last_read").alias("last_read"))


_RANK = "CASE WHEN language = 'eng' THEN 0 WHEN language IS NULL THEN 1 ELSE 2 END"


@query(f"WITH {_BOOKS} SELECT p_brand AS isbn, id, row_number() OVER (PARTITION BY p_brand ORDER BY {_RANK}, id) AS place FROM b QUALIFY place <= 5")
def dump_lookup(t: Tables):
    """The first five entries for each key: the preferred language, then none, then others."""
    from pyspark.sql.window import Window

    rank = F.when(F.col("language") == "eng", 0).when(F.col("language").isNull(), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(rank, "id"))
    return books(t).select(F.col("p_brand").alias("isbn"), "id", place.alias("place")).where("place <= 5")


def title_lookup_rows(rows, words: str, most: int):
    """Books that have all words in their title, else those whose title holds the text; the preferred language first."""
    key, wanted = search_key(F.col("title")), search_key(F.lit(words))
    rank = F.when(F.col("language") == "eng", 0).when(F.col("language").isNull(), 1).otherwise(2)
    all_words = F.size(F.array_except(F.split(wanted, " "), F.split(key, " "))) == 0
    marked = rows.select("id", all_words.alias("words"), key.contains(wanted).alias("part"), rank.alias("rank")).where("words or part")
    some = marked.agg(F.coalesce(F.bool_or("words"), F.lit(False)).alias("some"))  # one row
    return marked.join(F.broadcast(some)).where("words or not some").orderBy("rank", "id").limit(most).select("id", "words")


@query(f"WITH {_BOOKS} SELECT id, true AS words FROM b WHERE list_has_all(string_split(title, ' '), ['ring', 'small']) ORDER BY {_RANK}, id LIMIT 10")
def title_lookup(t: Tables):
    """All words of a query in the title, whatever their order; ten results."""
    return title_lookup_rows(books(t), "Ring SMALL", 10)


@query(f"WITH {_BOOKS} SELECT id, false AS words FROM b WHERE contains(title, 'l ri') ORDER BY {_RANK}, id LIMIT 15")
def title_lookup_fallback(t: Tables):
    """No title has the words: then those that hold the text; fifteen results."""
    return title_lookup_rows(books(t), "l ri", 15)


@query(f"""
WITH {_BOOKS}, old AS (SELECT id, read_status, page_count FROM b WHERE id % 4 <> 0), new AS (SELECT id, CASE WHEN id % 10 = 1 THEN 'READ' ELSE read_status END AS read_status, page_count FROM b WHERE id % 9 <> 0)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'NewEntitlement' WHEN n.id IS NULL THEN 'RemovedEntitlement' ELSE 'ChangedReadingState' END AS entitlement
FROM old o FULL JOIN new n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL OR o.read_status IS DISTINCT FROM n.read_status
""")
def sync_entitlements(t: Tables):
    """What a device must be told: books that it lacks, has to drop, or whose reading state changed."""
    b = books(t).select("id", "read_status")
    old = b.where("id % 4 <> 0").withColumnRenamed("read_status", "was").withColumn("o", F.lit(True))
    new = b.where("id % 9 <> 0").withColumn("read_status", F.when(F.col("id") % 10 == 1, "READ").otherwise(F.col("read_status"))).withColumn("n", F.lit(True))
    x = old.join(new, "id", "full")
    kind = F.when(F.col("o").isNull(), "NewEntitlement").when(F.col("n").isNull(), "RemovedEntitlement").when(~F.col("was").eqNullSafe(F.col("read_status")), "ChangedReadingState")
    return x.select("id", kind.alias("entitlement")).where("entitlement is not null")


@query(f"""WITH {_BOOKS} SELECT id, '{{"title":"' || title || '","authors":[' || array_to_string(['"' || a || '"' FOR a IN authors], ',') || ']' || CASE WHEN series_number IS NULL THEN '' ELSE ',"seriesNumber":' || series_number END || '}}' AS sidecar FROM b""")
def sidecar_json(t: Tables):
    """A book's sidecar: one JSON text, fields without value left out."""
    return books(t).select("id", F.to_json(F.struct("title", "authors", F.col("series_number").alias("seriesNumber"))).alias("sidecar"))


@query(f"""
WITH {_BOOKS} SELECT id, CASE WHEN file_size_kb < 1024 THEN printf('%.2f KB', CAST(file_size_kb AS DOUBLE)) WHEN file_size_kb < 1048576 THEN printf('%.2f MB', round(file_size_kb / 1024.0, 2)) ELSE printf('%.2f GB', round(file_size_kb / 1048576.0, 2)) END AS size FROM b
""")
def size_labels(t: Tables):
    """Sizes in KB, MB or GB with two figures."""
    k = F.col("file_size_kb")
    label = lambda c, unit: F.format_string(f"%.2f {unit}", F.round(c, 2))
    return books(t).select("id", F.when(k < 1024, label(k.cast("double"), "KB")).when(k < 1048576, label(k / 1024.0, "MB")).otherwise(label(k / 1048576.0, "GB")).alias("size"))


@query("SELECT h AS content, count(*) AS files, min(doc_id) AS first FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) GROUP BY 1")
def content_hashes(t: Tables):
    """Files by the hash of their content: equal contents are one file."""
    h = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return h.groupBy("content").agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))
