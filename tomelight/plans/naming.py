"""File-name patterns, path templates, names, release scores and interval tracks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.filedates import pattern_fields, within_bytes
from ..functions.naming import extracted, hashed_features, java_hash, name_strength, path_template
from .registry import Tables, query


@query("SELECT p_partkey, p_name AS title, p_brand AS author, '1999' AS y FROM part")
def file_name_fields(t: Tables):
    """Fields taken out of file names by a pattern."""
    name = F.concat("p_name", F.lit(" - "), "p_brand", F.lit(" (1999).epub"))
    x = t.part.select("p_partkey", extracted(name, "{Title} - {Authors} ({Year})").alias("f"))
    return x.select("p_partkey", F.col("f.Title").alias("title"), F.col("f.Authors").alias("author"), F.col("f.Year").alias("y"))


@query("SELECT p_partkey, upper(p_brand) || '/' || CASE WHEN p_size > 25 THEN 'S' || p_size || '/' ELSE 'single/' END || p_name || '.epub' AS path FROM part")
def library_paths(t: Tables):
    """Paths by a template with an optional part."""
    series = F.when(F.col("p_size") > 25, F.col("p_size"))
    return t.part.select("p_partkey", path_template("{authors:upper}/<S{series}/|single/>{title}.epub", {"authors": F.col("p_brand"), "series": series, "title": F.col("p_name")}).alias("path"))


@query("SELECT c_custkey, 2 AS same, 2 AS turned, 0 AS other FROM customer")
def name_agreement(t: Tables):
    """Strength of agreement of person names."""
    name = F.replace("c_name", F.lit("#"), F.lit(" "))
    turned = F.regexp_replace(name, r"^(\S+) (\S+)$", "$2, $1")
    return t.customer.select("c_custkey", name_strength(name, F.upper(name)).alias("same"), name_strength(name, turned).alias("turned"), name_strength(name, F.lit("Nobody Else")).alias("other"))


@query("""
SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END::INTEGER AS hash
FROM (SELECT p_partkey, list_reduce(list_concat([0::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(p_brand, '')]), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
""")
def hashed_names(t: Tables):
    return t.part.select("p_partkey", java_hash(F.col("p_brand")).alias("hash"))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part),
h AS (SELECT p_partkey, list_reduce(list_concat([0::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(w, '')]), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM w),
p AS (SELECT p_partkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 128 AS place, count(*) AS n FROM h GROUP BY 1, 2),
u AS (SELECT p_partkey, place, n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)) AS x FROM p)
SELECT p_partkey, CAST(place AS INTEGER) AS place, round(x, 6) AS x FROM u
""")
def hashed_vectors(t: Tables):
    """Hashed word counts of unit length: their components that aren't zero."""
    v = hashed_features(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    x = t.part.select("p_partkey", F.posexplode(v).alias("place", "x")).where("x <> 0")
    return x.select("p_partkey", "place", F.round("x", 6).alias("x"))


@query("""
SELECT p_partkey, least(45, 15 * len(string_split(p_type, ' '))) + CASE WHEN p_size % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 8 ELSE 15 END - CASE WHEN p_size > 45 THEN 50 ELSE 0 END AS score FROM part
""")
def release_scores(t: Tables):
    """An additive score with caps and penalties."""
    words = F.size(F.split("p_type", " "))
    score = F.least(F.lit(45), words * 15) + F.when(F.col("p_size") % 2 == 0, 25).otherwise(0) + F.when(F.col("p_retailprice") > 1000, 8).otherwise(15) - F.when(F.col("p_size") > 45, 50).otherwise(0)
    return t.part.select("p_partkey", score.alias("score"))


@query("""
SELECT p_brand, p_size, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS richest, count(*) AS found FROM part GROUP BY 1, 2
""")
def richest_result(t: Tables):
    """Results with one key: the richest stays, the first of equals."""
    return t.part.groupBy("p_brand", "p_size").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("richest"), F.count("*").alias("found"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, hour(ts) * 60.0 + minute(ts) AS a, hour(ts) * 60.0 + minute(ts) + value AS b FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY a, event_id) AS k FROM e),
r AS (SELECT user_id, day, k, event_id, 0 AS track, b AS e0, CAST(NULL AS DOUBLE) AS e1, CAST(NULL AS DOUBLE) AS e2 FROM n WHERE k = 1
UNION ALL SELECT user_id, day, k, event_id, track, CASE WHEN track = 0 THEN greatest(e0, b) ELSE e0 END, CASE WHEN track = 1 THEN greatest(coalesce(e1, b), b) ELSE e1 END, CASE WHEN track = 2 THEN greatest(coalesce(e2, b), b) ELSE e2 END
FROM (SELECT n.user_id, n.day, n.k, n.event_id, n.b, r.e0, r.e1, r.e2, CASE WHEN r.e0 <= n.a THEN 0 WHEN r.e1 <= n.a THEN 1 WHEN r.e2 <= n.a THEN 2 WHEN r.e1 IS NULL THEN 1 ELSE 2 END AS track FROM r JOIN n ON n.user_id = r.user_id AND n.day = r.day AND n.k = r.k + 1))
SELECT event_id, CAST(track AS BIGINT) AS track FROM r
""")
def session_tracks(t: Tables):
    """Sessions of a user's day on at most three tracks, without overlap where that is possible; overflow shares the last.

    The days pass through a task one after another in the order of their sessions; only the three ends of the current day are held.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ends = None, []
        for batch in batches:
            tracks = []
            for *day, start, end in zip(*(batch[c].to_pylist() for c in ("user_id", "day", "start", "end")), strict=True):
                if day != current:
                    current, ends = day, []
                track = next((i for i, last in enumerate(ends) if last is not None and start is not None and last <= start), min(len(ends), 2))
                if track == len(ends):
                    ends.append(end)
                elif ends[track] is None or end is not None and (end > ends[track] or end != end):
                    ends[track] = end
                tracks.append(track)
            yield pa.RecordBatch.from_arrays([batch["event_id"], pa.array(tracks, pa.int64())], ["event_id", "track"])

    start = F.hour("ts") * 60.0 + F.minute("ts")
    rows = t.events.select("event_id", "user_id", F.unix_date(F.to_date("ts")).alias("day"), start.alias("start"), (start + F.col("value")).alias("end"))
    return rows.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "start", "event_id").mapInArrow(pack, "event_id long, track long")


def _tokens(text, least: int = 3):
    """Distinct lower-cased runs of ASCII letters and digits of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


@query("""
WITH w AS (SELECT p_partkey, list_distinct([x for x in regexp_split_to_array(lower(p_name), '[^a-z0-9]+') if length(x) >= 3]) AS a, list_distinct([x for x in regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+') if length(x) >= 3]) AS b FROM part)
SELECT p_partkey, len(a) > 0 AND len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) >= 0.4 AS agrees FROM w
""")
def token_overlap(t: Tables):
    """Whether two titles share 0.4 or more of their tokens."""
    a, b = _tokens(F.col("p_name")), _tokens(F.concat_ws(" ", "p_name", "p_type"))
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return t.part.select("p_partkey", ((F.size(a) > 0) & F.coalesce(share >= 0.4, F.lit(False))).alias("agrees"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS isbn, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT p_partkey, p_name FROM part WHERE p_size > 10), n AS (SELECT lower(p_name) AS title, min(p_partkey) AS id FROM k GROUP BY 1), w AS (SELECT DISTINCT lower(p_name) AS title FROM part WHERE p_size <= 10)
SELECT r.l_orderkey, r.l_linenumber, coalesce(k.p_partkey, n.id) AS owned, w.title IS NOT NULL AS wanted
FROM r LEFT JOIN k ON k.p_partkey = r.isbn LEFT JOIN n ON n.title = lower(r.title) LEFT JOIN w ON w.title = lower(r.title)
""")
def owned_results(t: Tables):
    """Search results marked as owned, by identifier first and then by normalised title, and as wanted."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    r = line.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("isbn"), F.lower("p_name").alias("title"))
    held = t.part.where("p_size > 10")
    by_id = held.select(F.col("p_partkey").alias("isbn"), F.col("p_partkey").alias("a"))
    by_title = held.groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("b"))
    wished = t.part.where("p_size <= 10").select(F.lower("p_name").alias("title"), F.lit(True).alias("w")).distinct()
    x = r.join(by_id, "isbn", "left").join(by_title, "title", "left").join(wished, "title", "left")
    return x.select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("owned"), F.coalesce("w", F.lit(False)).alias("wanted"))


@query("SELECT p_partkey, replace(p_brand, '#', ' ') AS author FROM part WHERE p_size % 3 < 2")
def authors_of_file_names(t: Tables):
    """Author taken from "Last, First - Title" or "Title - Author", where the title part agrees and the rest can be a name."""
    last, first = F.regexp_extract("p_brand", r"#(\d+)", 1), F.regexp_extract("p_brand", r"^(\w+)#", 1)
    kind = F.col("p_size") % 3
    name = F.when(kind == 0, F.concat(last, F.lit(", "), first, F.lit(" - "), F.col("p_name"))).when(kind == 1, F.concat("p_name", F.lit(" - "), first, F.lit(" "), last)).otherwise(F.col("p_name"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    parts = F.split(name, " - ")
    left, right = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    title = plain(F.col("p_name"))
    other = F.when(plain(right) == title, left).when(plain(left) == title, right)
    turned = F.trim(F.regexp_replace(other, r"^([^,]*),\s*(.+)$", "$2 $1"))
    return t.part.select("p_partkey", turned.alias("author")).where("author is not null")


#: Forms in which a date may be written: (SQL for the text, SQL for the date that it gives).
_DATES = [
    ("strftime(d, '%Y')", "make_date(year(d), 1, 1)"), ("strftime(d, '%y')", "make_date(CASE WHEN year(d) % 100 < 50 THEN 2000 ELSE 1900 END + year(d) % 100, 1, 1)"), ("strftime(d, '%Y%m%d')", "d"), ("year(d) || '-' || month(d)", "make_date(year(d), month(d), 1)"),
    ("month(d) || '/' || year(d)", "make_date(year(d), month(d), 1)"), ("strftime(d, '%Y.%m.%d')", "d"), ("day(d) || '-' || month(d) || '-' || year(d)", "d"), ("year(d) || '_' || day(d) || '_' || month(d)", "CASE WHEN day(d) > 12 THEN d ELSE make_date(year(d), day(d), month(d)) END"),
    ("strftime(d, '%Yx%m')", "CAST(NULL AS DATE)"),
]


@query("WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {want}" for i, (_, want) in enumerate(_DATES)) + " END AS published, CASE WHEN o_orderkey % 9 = 8 THEN 'no date' ELSE 'Saga' END AS series, CAST(o_orderkey % 7 + 0.5 AS FLOAT) AS number FROM o")
def file_name_dates(t: Tables):
    """Published dates that file names give in nine forms, by one pattern with typed fields."""
    d, y, m, day = F.to_date("o_orderdate"), F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    texts = [y.cast("string"), F.date_format(d, "yy"), F.date_format(d, "yyyyMMdd"), F.concat_ws("-", y, m), F.concat_ws("/", m, y), F.date_format(d, "yyyy.MM.dd"), F.concat_ws("-", day, m, y), F.concat_ws("_", y, day, m), F.concat(y, F.lit("x"), F.lpad(m.cast("string"), 2, "0"))]
    turn = F.col("o_orderkey") % 9
    text = texts[0]
    for i, one in enumerate(texts[1:], 1):
        text = F.when(turn == i, one).otherwise(text)
    series = F.when(turn == 8, "no date").otherwise("Saga")
    name = F.concat(series, F.lit(" #"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".5 - Title, second ("), text, F.lit(")"))
    x = t.orders.select("o_orderkey", pattern_fields(name, "{SeriesName} #{SeriesNumber} - {Title} ({Published})").alias("f"))
    return x.select("o_orderkey", F.col("f.Published").alias("published"), F.col("f.SeriesName").alias("series"), F.col("f.SeriesNumber").alias("number"))


@query(r"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, 41) AS s FROM documents),
c AS (SELECT doc_id, t, CASE WHEN strlen(t) <= 40 THEN t ELSE regexp_replace(substr(s, 1, coalesce(list_max([i FOR i IN range(0, 42) IF strlen(substr(s, 1, i)) <= 40]), 0)), '[\s\p{Z}]+$', '') END AS cut FROM x)
SELECT doc_id, cut, strlen(cut) AS bytes FROM c
""")
def byte_budgets(t: Tables):
    """Names of at most 40 bytes from texts of several scripts."""
    cut = within_bytes(F.coalesce("text", F.lit("")), 40)
    return t.documents.select("doc_id", cut.alias("cut")).select("doc_id", "cut", F.octet_length("cut").alias("bytes"))
