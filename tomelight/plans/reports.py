"""Listening, rating and profile reports over events and part as a catalogue of books."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up
from ..operators.catalogue import PROGRESS
from . import sessions
from .browse import _BOOKS, books
from .registry import ORACLES, Tables, query

#: Clicks play the listening sessions; props names the book.
_HEARD = "h AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book FROM events WHERE event_type = 'click')"


def _heard(t: Tables):
    return t.events.where("event_type = 'click'").withColumn("book", F.get_json_object("props", "$.k").cast("long"))


@query(f"WITH {_HEARD} SELECT CAST(hour(ts + INTERVAL 3 HOUR) AS INTEGER) AS hour, count(*) AS sessions, round(sum(value), 4) AS minutes FROM h WHERE year(ts + INTERVAL 3 HOUR) = 2024 AND month(ts + INTERVAL 3 HOUR) = 1 GROUP BY 1")
def listening_peak_hours(t: Tables):
    """Listening sessions by hour on the user's clock, of one month."""
    local = F.col("ts") + F.expr("interval 3 hours")
    h = _heard(t).withColumn("local", local).where((F.year("local") == 2024) & (F.month("local") == 1))
    return h.groupBy(F.hour("local").alias("hour")).agg(F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query(f"WITH {_BOOKS}, {_HEARD}, g AS (SELECT id, unnest(categories) AS genre FROM b) SELECT genre, count(DISTINCT book) AS books, count(*) AS sessions, round(sum(value), 4) AS minutes FROM h JOIN g ON g.id = h.book GROUP BY 1")
def listening_genres(t: Tables):
    """Books, sessions and minutes of each genre."""
    g = books(t).select(F.col("id").alias("book"), F.explode("categories").alias("genre"))
    return _heard(t).join(g, "book").groupBy("genre").agg(F.count_distinct("book").alias("books"), F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query(f"WITH {_BOOKS}, {_HEARD}, g AS (SELECT id, unnest(authors) AS author FROM b) SELECT author, count(DISTINCT book) AS books, count(*) AS sessions, round(sum(value), 4) AS minutes FROM h JOIN g ON g.id = h.book GROUP BY 1")
def listening_authors(t: Tables):
    """Books, sessions and minutes of each author."""
    g = books(t).select(F.col("id").alias("book"), F.explode("authors").alias("author"))
    return _heard(t).join(g, "book").groupBy("author").agg(F.count_distinct("book").alias("books"), F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query(f"WITH {_HEARD} SELECT event_id, round(hour(ts) + minute(ts) / 60.0, 6) AS hour, round(value, 4) AS minutes, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday FROM h ORDER BY ts DESC, event_id LIMIT 500")
def listening_scatter(t: Tables):
    """The latest 500 listening sessions as points."""
    x = _heard(t).orderBy(F.desc("ts"), "event_id").limit(500)
    return x.select("event_id", F.round(F.hour("ts") + F.minute("ts") / 60.0, 6).alias("hour"), F.round("value", 4).alias("minutes"), F.dayofweek("ts").alias("weekday"))


@query(f"WITH {_BOOKS} SELECT CAST(r AS INTEGER) AS rating, count(id) AS books FROM range(1, 11) g(r) LEFT JOIN b ON personal_rating = r GROUP BY 1")
def rating_histogram(t: Tables):
    """Books at each exact personal rating from 1 to 10, zeros included."""
    n = books(t).groupBy(F.col("personal_rating").cast("int").alias("rating")).agg(F.count("*").alias("n"))
    scale = t.spark.range(1, 11).select(F.col("id").cast("int").alias("rating"))
    return scale.join(n, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("books"))


#: The bands of reading progress; what lies between two of them is in none.
BANDS = [("0%", 0, 0), ("1-25%", 0.1, 25), ("26-50%", 26, 50), ("51-75%", 51, 75), ("76-99%", 76, 99), ("100%", 100, 100)]
_PROGRESS = "coalesce(" + ", ".join(f"{p}_progress" for p in PROGRESS) + ", 0)"


@query(f"WITH {_BOOKS}, p AS (SELECT {_PROGRESS} AS p FROM b) " + " UNION ALL ".join(f"SELECT '{n}' AS band, count(*) AS books FROM p WHERE p BETWEEN {a} AND {b}" for n, a, b in BANDS))
def progress_bands(t: Tables):
    """Books by band of progress, in one pass; zeros included."""
    p = F.coalesce(*[F.col(f"{x}_progress") for x in PROGRESS], F.lit(0.0))
    one = books(t).agg(*[F.count_if(p.between(a, b)).alias(n.replace("%", "")) for n, a, b in BANDS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"`{n.replace('%', '')}`").alias("books")) for n, _, _ in BANDS])).alias("x")).select("x.band", "x.books")


@query(f"""
WITH {_BOOKS}, r AS (SELECT CAST(year(published) // 10 * 10 AS VARCHAR) || 's' AS decade, least(4, (personal_rating - 1) // 2) AS bucket, personal_rating AS r FROM b WHERE published IS NOT NULL AND personal_rating > 0 AND year(published) BETWEEN 1900 AND 2030),
a AS (SELECT decade, avg(r) AS mean FROM r GROUP BY 1)
SELECT decade, ['1-2', '3-4', '5-6', '7-8', '9-10'][CAST(bucket AS INTEGER) + 1] AS ratings, count(*) AS books, decade = (SELECT arg_max(decade, (mean, -CAST(left(decade, 4) AS INTEGER))) FROM a) AS best FROM r GROUP BY 1, 2
""")
def era_ratings(t: Tables):
    """Ratings in five buckets by decade of publication; the decade with the best mean."""
    year, r = F.year("published"), F.col("personal_rating")
    x = books(t).where(F.col("published").isNotNull() & (r > 0) & year.between(1900, 2030))
    x = x.select((F.floor(year / 10) * 10).alias("d"), F.least(F.lit(4), F.floor((r - 1) / 2)).cast("int").alias("bucket"), r.alias("r"))
    best = x.groupBy("d").agg(F.avg("r").alias("mean")).agg(F.max_by("d", F.struct("mean", -F.col("d"))).alias("best"))  # one row
    names = F.array(*[F.lit(n) for n in ("1-2", "3-4", "5-6", "7-8", "9-10")])
    counts = x.groupBy("d", "bucket").agg(F.count("*").alias("books")).join(F.broadcast(best))
    return counts.select(F.concat(F.col("d").cast("string"), F.lit("s")).alias("decade"), F.get(names, F.col("bucket")).alias("ratings"), "books", (F.col("d") == F.col("best")).alias("best"))


@query(f"""
WITH {_BOOKS}, e AS (SELECT date_trunc('month', greatest(max(added), max(finished))) AS last FROM b), m AS (SELECT CAST(last - to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM e, range(12) g(i)),
a AS (SELECT CAST(date_trunc('month', added) AS DATE) AS month, count(*) AS n FROM b GROUP BY 1), f AS (SELECT CAST(date_trunc('month', finished) AS DATE) AS month, count(*) AS n FROM b GROUP BY 1)
SELECT month, coalesce(a.n, 0) AS added, coalesce(f.n, 0) AS finished, CAST(sum(coalesce(a.n, 0) - coalesce(f.n, 0)) OVER (ORDER BY month) AS BIGINT) AS backlog FROM m LEFT JOIN a USING (month) LEFT JOIN f USING (month)
""")
def reading_debt(t: Tables):
    """The last twelve months without gaps: books added, books finished, and the running difference."""
    x = books(t).select("added", "finished")
    last = x.agg(F.trunc(F.greatest(F.max("added"), F.max("finished")), "month").alias("last"))  # one row
    months = last.select(F.explode(F.sequence(F.add_months("last", -11), "last", F.expr("interval 1 month"))).alias("month"))
    a = x.groupBy(F.trunc("added", "month").alias("month")).agg(F.count("*").alias("a"))
    f = x.groupBy(F.trunc("finished", "month").alias("month")).agg(F.count("*").alias("f"))
    joined = months.join(a, "month", "left").join(f, "month", "left").select("month", F.coalesce("a", F.lit(0)).alias("added"), F.coalesce("f", F.lit(0)).alias("finished"))
    # twelve rows
    return joined.withColumn("backlog", F.sum(F.col("added") - F.col("finished")).over(Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


#: Genres of the profile's scores.
GENRES = {
    "intellectual": "philosophy history biography politics psychology economics mathematics engineering medicine law education sociology nonfiction non-fiction academic".split(),
    "emotional": ["romance", "memoir", "poetry", "drama", "self-help", "autobiography", "literary fiction", "coming of age"],
    "social": ["thriller", "mystery", "crime", "suspense", "horror", "fantasy", "science fiction", "adventure", "true crime", "humor", "graphic novel", "manga", "comic"],
    "nostalgic": ["classic", "mythology", "folklore", "fairy tale", "ancient", "medieval", "victorian", "gothic"],
}
NOW_YEAR = 2024
_IN = {n: "len([c FOR c IN categories IF " + " OR ".join(f"contains(c, '{g}')" for g in gs) + "]) > 0" for n, gs in GENRES.items()}


@query(f"""
WITH {_BOOKS}, g AS (SELECT library, count(DISTINCT c) AS genres FROM (SELECT library, unnest(categories) AS c FROM b) GROUP BY 1),
s AS (SELECT library, count(*) * 1.0 AS n, count(DISTINCT nullif(language, '')) AS languages, sum(CASE WHEN read_status = 'READ' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN personal_rating > 0 THEN 1 ELSE 0 END) AS rated, sum(CASE WHEN personal_rating >= 4 THEN 1 ELSE 0 END) AS high,
  sum(CASE WHEN page_count > 400 THEN 1 ELSE 0 END) AS p400, sum(CASE WHEN page_count > 500 THEN 1 ELSE 0 END) AS p500, sum(CASE WHEN page_count > 600 THEN 1 ELSE 0 END) AS p600, sum(CASE WHEN page_count > 600 AND read_status = 'READ' THEN 1 ELSE 0 END) AS done600,
  sum(CASE WHEN {_IN["intellectual"]} THEN 1 ELSE 0 END) AS mind, sum(CASE WHEN {_IN["emotional"]} THEN 1 ELSE 0 END) AS heart, sum(CASE WHEN {_IN["social"]} THEN 1 ELSE 0 END) AS crowd, sum(CASE WHEN {_IN["nostalgic"]} THEN 1 ELSE 0 END) AS past,
  sum(CASE WHEN series_name IS NOT NULL AND series_number > 0 THEN 1 ELSE 0 END) AS series, sum(CASE WHEN {_PROGRESS} > 50 THEN 1 ELSE 0 END) AS half, sum(CASE WHEN goodreads_review_count > 10000 OR amazon_review_count > 2000 THEN 1 ELSE 0 END) AS popular,
  sum(CASE WHEN year(published) < {NOW_YEAR - 30} THEN 1 ELSE 0 END) AS old FROM b GROUP BY 1),
x AS (SELECT library, unnest([{{'score': 'adventurous', 'value': least(75, genres / greatest(1, n * 0.4) * 75) + least(25, greatest(0, languages - 1) * 12.5)}}, {{'score': 'perfectionist', 'value': done / n * 60 + coalesce(high * 1.0 / nullif(rated, 0), 0) * 40}},
  {{'score': 'intellectual', 'value': mind / n * 70 + p400 / n * 30}}, {{'score': 'emotional', 'value': heart / n * 70 + rated / n * 30}}, {{'score': 'patience', 'value': p500 / n * 40 + series / n * 35 + half / n * 25}}, {{'score': 'social', 'value': crowd / n * 50 + popular / n * 50}},
  {{'score': 'nostalgic', 'value': old / n * 60 + past / n * 40}}, {{'score': 'ambitious', 'value': least(40, n * 0.4) + p600 / n * 35 + coalesce(done600 * 1.0 / nullif(p600, 0), 0) * 25}}]) AS s FROM s JOIN g USING (library))
SELECT library, s.score AS score, CAST(least(100, floor(round(s.value, 6) + 0.5)) AS BIGINT) AS value FROM x
""")
def reading_dna(t: Tables):
    """Eight scores from 0 to 100 of each library's books, by one wide aggregate."""
    b, c = books(t), F.col
    n = F.count("*")
    share = lambda test: F.count_if(F.coalesce(test, F.lit(False))) / n
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    some = {name: F.exists("categories", _any_of(genres)) for name, genres in GENRES.items()}
    done, rating, pages = c("read_status") == "READ", c("personal_rating"), c("page_count")
    progress = F.coalesce(*[c(f"{p}_progress") for p in PROGRESS], F.lit(0.0))
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    scores = {
        "perfectionist": share(done) * 60 + ratio(count(rating >= 4), count(rating > 0)) * 40, "intellectual": share(some["intellectual"]) * 70 + share(pages > 400) * 30, "emotional": share(some["emotional"]) * 70 + share(rating > 0) * 30,
        "patience": share(pages > 500) * 40 + share(c("series_name").isNotNull() & (c("series_number") > 0)) * 35 + share(progress > 50) * 25, "social": share(some["social"]) * 50 + share((c("goodreads_review_count") > 10000) | (c("amazon_review_count") > 2000)) * 50,
        "nostalgic": share(F.year("published") < NOW_YEAR - 30) * 60 + share(some["nostalgic"]) * 40, "ambitious": F.least(F.lit(40.0), n * 0.4) + share(pages > 600) * 35 + ratio(count((pages > 600) & done), count(pages > 600)) * 25,
    }
    wide = b.groupBy("library").agg(n.alias("n"), F.count_distinct(F.nullif("language", F.lit(""))).alias("languages"), *[s.alias(k) for k, s in scores.items()])
    genres = b.select("library", F.explode("categories").alias("genre")).groupBy("library").agg(F.count_distinct("genre").alias("genres"))
    wild = F.least(F.lit(75.0), c("genres") / F.greatest(F.lit(1.0), c("n") * 0.4) * 75) + F.least(F.lit(25.0), F.greatest(F.lit(0), c("languages") - 1) * 12.5)
    rows = wide.join(genres, "library").withColumn("adventurous", wild)
    listed = F.array(*[F.struct(F.lit(k).alias("score"), F.least(F.lit(100), half_up(F.round(k, 6), 0)).cast("long").alias("value")) for k in ("adventurous", *scores)])
    return rows.select("library", F.explode(listed).alias("s")).select("library", "s.score", "s.value")


def _any_of(genres):
    pattern = "|".join(genres)
    return lambda category: category.rlike(pattern)


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
s AS (SELECT user_id, island, count(*) AS length FROM i GROUP BY 1, 2), e AS (SELECT max(CAST(ts AS DATE)) AS today FROM events),
u AS (SELECT user_id, count(*) AS days, min(day) AS first FROM d GROUP BY 1)
SELECT u.user_id, days, (SELECT max(length) FROM s WHERE s.user_id = u.user_id) AS longest, CASE WHEN days >= 2 THEN CAST(floor(days * 100.0 / (today - first + 1) + 0.5) AS BIGINT) ELSE 0 END AS consistency,
  (SELECT max(length) FROM s WHERE s.user_id = u.user_id) >= 7 AS week_streak, (SELECT max(length) FROM s WHERE s.user_id = u.user_id) >= 30 AS month_streak, days >= 100 AS hundred_days, days >= 365 AS year_days FROM u, e
""")
def reading_milestones(t: Tables):
    """Each user's days, longest streak, consistency since the first day, and milestones."""
    d = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    s = d.withColumn("island", F.date_sub("day", k)).groupBy("user_id", "island").agg(F.count("*").alias("length"), F.min("day").alias("first"))
    u = s.groupBy("user_id").agg(F.sum("length").alias("days"), F.max("length").alias("longest"), F.min("first").alias("first"))
    today = t.events.agg(F.max(F.to_date("ts")).alias("today"))  # one row
    part = F.floor(F.col("days") * 100.0 / (F.date_diff("today", "first") + 1) + 0.5).cast("long")
    x = u.join(F.broadcast(today)).withColumn("consistency", F.when(F.col("days") >= 2, part).otherwise(F.lit(0).cast("long")))
    return x.select("user_id", "days", "longest", "consistency", (F.col("longest") >= 7).alias("week_streak"), (F.col("longest") >= 30).alias("month_streak"), (F.col("days") >= 100).alias("hundred_days"), (F.col("days") >= 365).alias("year_days"))


@query(f"""
WITH p AS ({ORACLES["page_turner"]}), r AS (SELECT *, row_number() OVER (ORDER BY grip DESC, user_id) AS place FROM p)
SELECT user_id, grip, place, place <= 3 AS top, (SELECT CAST(floor(avg(grip) + 0.5) AS BIGINT) FROM p) AS mean FROM r WHERE place <= 15
""")
def page_turner_summary(t: Tables):
    """The fifteen best grip scores, the top three marked, and the mean of all."""
    p = sessions.page_turner(t)
    mean = p.agg(F.floor(F.avg("grip") + 0.5).cast("long").alias("mean"))  # one row
    top = p.orderBy(F.desc("grip"), "user_id").limit(15)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("grip"), "user_id"))
    return top.withColumn("place", place).join(F.broadcast(mean)).select("user_id", "grip", "place", (F.col("place") <= 3).alias("top"), "mean")


@query(f"""
WITH {_BOOKS}, x AS (SELECT *, nullif(trim(series_name), '') AS s FROM b) SELECT s AS series, count(*) AS books, sum(CASE WHEN read_status = 'READ' THEN 1 ELSE 0 END)::BIGINT AS done, CAST(sum(page_count) AS BIGINT) AS pages, round(avg(CASE WHEN personal_rating > 0 THEN personal_rating END), 4) AS mean,
CASE WHEN bool_or(coalesce(read_status = 'WONT_READ', false)) THEN 'WONT_READ' WHEN bool_or(coalesce(read_status = 'ABANDONED', false)) THEN 'ABANDONED' WHEN bool_and(coalesce(read_status = 'READ', false)) THEN 'READ'
 WHEN bool_or(coalesce(read_status IN ('READING', 'RE_READING', 'PAUSED'), false)) THEN 'READING' WHEN bool_or(coalesce(read_status = 'READ', false)) THEN 'PARTIALLY_READ' ELSE 'UNREAD' END AS status FROM x WHERE s IS NOT NULL GROUP BY 1
""")
def series_page_stats(t: Tables):
    """A series' page: its books, those read, pages, mean rating, and one status by precedence."""
    series = F.nullif(F.trim("series_name"), F.lit(""))
    status = lambda *names: F.coalesce(F.col("read_status").isin(*names), F.lit(False))
    one = F.when(F.bool_or(status("WONT_READ")), "WONT_READ").when(F.bool_or(status("ABANDONED")), "ABANDONED").when(F.bool_and(status("READ")), "READ")
    one = one.when(F.bool_or(status("READING", "RE_READING", "PAUSED")), "READING").when(F.bool_or(status("READ")), "PARTIALLY_READ").otherwise("UNREAD")
    x = books(t).withColumn("series", series).where("series is not null")
    return x.groupBy("series").agg(
        F.count("*").alias("books"), F.count_if(status("READ")).alias("done"), F.sum("page_count").cast("long").alias("pages"), F.round(F.avg(F.when(F.col("personal_rating") > 0, F.col("personal_rating"))), 4).alias("mean"), one.alias("status")
    )
