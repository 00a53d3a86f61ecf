"""Eight scores of a reader's habits, each 0 to 100. A library plays the reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .browse import _BOOKS, books
from .registry import Tables, query

#: The day on which the scores are taken, and half a year before it.
TODAY, RECENT = "2024-11-01", "2024-05-01"
ACTIVE, READ = ("READING", "RE_READING"), "READ"
SOURCES = ("epub_progress", "pdf_progress", "cbx_progress", "koreader_progress", "kobo_progress")


def _rounded(x):
    return F.least(F.lit(100), F.floor(x + F.lit(0.5))).cast("int")


def _capped(x, most: float):
    return F.least(F.lit(float(most)), x.cast("double"))


@query(f"""
WITH {_BOOKS}, x AS (SELECT *, greatest({", ".join(f"coalesce({c}, 0)" for c in SOURCES)}) AS p, coalesce(read_status = 'READ', false) AS done, coalesce(read_status IN {ACTIVE}, false) AS active FROM b),
a AS (SELECT library, count(*) AS n, count(*) FILTER (active) AS active, count(*) FILTER (NOT active AND NOT done AND p > 10 AND p < 90) AS part, count(*) FILTER (done OR active OR coalesce(read_status = 'ABANDONED', false) OR p > 0) AS started, count(*) FILTER (done) AS done, count(*) FILTER (read_status = 'ABANDONED') AS gone,
  max(year(published)) - min(year(published)) AS spread, count(year(published)) AS dated, count(DISTINCT nullif(language, '')) AS languages, count(*) FILTER (done AND personal_rating > 0) AS rated, count(*) FILTER (read_status IS NOT NULL AND read_status <> 'UNSET') AS told,
  count(*) FILTER (series_name <> '') AS in_series, count(*) FILTER (series_name <> '' AND series_number <> 0) AS numbered, avg(page_count) FILTER (page_count > 0) AS pages, count(*) FILTER (p > 75) AS deep, count(*) FILTER (done AND finished > DATE '{RECENT}') AS recent, count(*) FILTER (p > 70 AND p < 100 AND NOT done) AS almost FROM x GROUP BY 1),
d AS (SELECT library, finished, date_diff('day', lag(finished) OVER (PARTITION BY library ORDER BY finished), finished) AS gap FROM x WHERE done AND finished IS NOT NULL),
g AS (SELECT library, count(*) AS k, avg(gap) AS mean, stddev_pop(gap) AS dev FROM d GROUP BY 1),
w AS (SELECT library, lower(series_name) AS s, finished, lag(finished) OVER (PARTITION BY library, lower(series_name) ORDER BY series_number, id) AS before FROM x WHERE series_name <> '' AND series_number <> 0),
o AS (SELECT library, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) AS ordered FROM (SELECT library, s, bool_and(coalesce(finished >= before, true)) AS good FROM w GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
au AS (SELECT library, count(*) AS authors, count(*) FILTER (c > 2) AS dives FROM (SELECT library, lower(n) AS n, count(*) AS c FROM (SELECT library, unnest(authors) AS n FROM b) GROUP BY 1, 2) GROUP BY 1),
ge AS (SELECT library, count(*) FILTER (c > 4) AS focused FROM (SELECT library, lower(n) AS n, count(*) AS c FROM (SELECT library, unnest(categories) AS n FROM b) GROUP BY 1, 2) GROUP BY 1)
SELECT library, CAST(CASE WHEN coalesce(k, 0) < 3 THEN least(20, coalesce(k, 0) * 10) WHEN mean = 0 THEN 50 ELSE least(100, floor(greatest(0, least(70, (1 - dev / mean / 2) * 70)) + least(30, k * 1.5) + 0.5)) END AS INTEGER) AS consistency,
  CAST(least(100, floor(least(75, CASE WHEN active <= 1 THEN active * 10 ELSE 10 + (active - 1) * 20 END) + least(25, part * 5) + 0.5)) AS INTEGER) AS multitasking,
  CAST(CASE WHEN started = 0 THEN 0 ELSE least(100, floor(done / started * 75.0 + (1 - gone / started) * 25.0 + 0.5)) END AS INTEGER) AS completionism,
  CAST(least(100, floor(least(60, coalesce(authors, 0) / n * 60.0) + CASE WHEN dated > 1 THEN least(25, spread * 0.5) ELSE 0 END + least(15, greatest(0, languages - 1) * 7.5) + 0.5)) AS INTEGER) AS exploration,
  CAST(least(100, floor(CASE WHEN done > 0 THEN rated / done ELSE 0 END * 40.0 + told / n * 35.0 + CASE WHEN in_series > 0 THEN numbered / in_series ELSE 1 END * 25.0 + 0.5)) AS INTEGER) AS organization,
  CAST(CASE WHEN pages IS NULL THEN 0 ELSE least(100, floor(least(60, pages / 10) + least(40, deep / n * 40.0) + 0.5)) END AS INTEGER) AS intensity,
  CAST(least(100, floor(coalesce(ordered * 50, 25) + least(30, coalesce(dives, 0) * 10) + least(20, coalesce(focused, 0) * 5) + 0.5)) AS INTEGER) AS methodology,
  CAST(least(100, floor(least(45, recent * 7.5) + least(30, active * 10) + least(25, almost * 8) + 0.5)) AS INTEGER) AS momentum
FROM a LEFT JOIN g USING (library) LEFT JOIN o USING (library) LEFT JOIN au USING (library) LEFT JOIN ge USING (library)
""")
def habit_scores(t: Tables):
    """Consistency, multitasking, completionism, exploration, organisation, intensity, methodology and momentum of each library's reader.

    Gaps between finished books are taken between days that are told apart first, so a window holds days and not books.
    """
    c, n_if = F.col, lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    p = reduce(F.greatest, [F.coalesce(s, F.lit(0.0)) for s in SOURCES])
    status = c("read_status")
    x = books(t).withColumns({"p": p, "done": F.coalesce(status == READ, F.lit(False)), "active": F.coalesce(status.isin(*ACTIVE), F.lit(False)), "gone": F.coalesce(status == "ABANDONED", F.lit(False)), "y": F.year("published")})
    series = c("series_name") != ""
    numbered = series & (c("series_number") != 0)
    a = x.groupBy("library").agg(
        F.count("*").alias("n"), n_if(c("active")).alias("active"), n_if(~c("active") & ~c("done") & (c("p") > 10) & (c("p") < 90)).alias("part"), n_if(c("done") | c("active") | c("gone") | (c("p") > 0)).alias("started"), n_if(c("done")).alias("done"), n_if(c("gone")).alias("gone"),
        (F.max("y") - F.min("y")).alias("spread"), F.count("y").alias("dated"), F.count_distinct(F.nullif(c("language"), F.lit(""))).alias("languages"), n_if(c("done") & (c("personal_rating") > 0)).alias("rated"), n_if(status.isNotNull() & (status != "UNSET")).alias("told"),
        n_if(series).alias("in_series"), n_if(numbered).alias("numbered"), F.avg(F.when(c("page_count") > 0, c("page_count"))).alias("pages"), n_if(c("p") > 75).alias("deep"), n_if(c("done") & (c("finished") > F.lit(RECENT).cast("date"))).alias("recent"), n_if((c("p") > 70) & (c("p") < 100) & ~c("done")).alias("almost"),
    )
    days = x.where("done and finished is not null").groupBy("library", "finished").agg(F.count("*").alias("on"))
    gap = F.date_diff("finished", F.lag("finished").over(Window.partitionBy("library").orderBy("finished")))
    g = days.withColumn("gap", gap.cast("double")).groupBy("library").agg(F.sum("on").alias("k"), F.sum("gap").alias("s1"), F.sum(c("gap") * c("gap")).alias("s2"))
    before = F.lag("finished").over(Window.partitionBy("library", "s").orderBy("series_number", "id"))
    w = x.where(numbered).withColumn("s", F.lower("series_name")).withColumn("before", before)
    kept = w.groupBy("library", "s").agg(F.bool_and(F.coalesce(c("finished") >= c("before"), F.lit(True))).alias("good"), F.count("*").alias("m")).where("m > 1")
    o = kept.groupBy("library").agg(F.avg(F.when(c("good"), 1.0).otherwise(0.0)).alias("ordered"))
    counted = lambda column: x.select("library", F.explode(column).alias("v")).groupBy("library", F.lower("v").alias("v")).agg(F.count("*").alias("c"))
    au = counted("authors").groupBy("library").agg(F.count("*").alias("authors"), F.count_if(c("c") > 2).alias("dives"))
    ge = counted("categories").groupBy("library").agg(F.count_if(c("c") > 4).alias("focused"))
    all_ = reduce(lambda left, right: left.join(right, "library", "left"), [a, g, o, au, ge])
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    k, gaps = zero("k"), zero("k") - 1
    mean = c("s1") / gaps
    deviation = F.sqrt(F.greatest(F.lit(0.0), c("s2") / gaps - mean * mean))
    regular = F.greatest(F.lit(0.0), _capped((1 - deviation / mean / 2) * 70, 70))
    consistency = F.when(k < 3, F.least(F.lit(20), k * 10).cast("int")).when(zero("s1") == 0, 50).otherwise(_rounded(regular + _capped(k * 1.5, 30)))
    return all_.select(
        "library", consistency.cast("int").alias("consistency"),
        _rounded(_capped(F.when(c("active") <= 1, c("active") * 10).otherwise(10 + (c("active") - 1) * 20), 75) + _capped(c("part") * 5, 25)).alias("multitasking"),
        F.when(c("started") == 0, 0).otherwise(_rounded(c("done") / c("started") * 75.0 + (1 - c("gone") / c("started")) * 25.0)).alias("completionism"),
        _rounded(_capped(zero("authors") / c("n") * 60.0, 60) + F.when(c("dated") > 1, _capped(c("spread") * 0.5, 25)).otherwise(0.0) + _capped(F.greatest(F.lit(0), c("languages") - 1) * 7.5, 15)).alias("exploration"),
        _rounded(F.when(c("done") > 0, c("rated") / c("done")).otherwise(0.0) * 40.0 + c("told") / c("n") * 35.0 + F.when(c("in_series") > 0, c("numbered") / c("in_series")).otherwise(1.0) * 25.0).alias("organization"),
        F.when(c("pages").isNull(), 0).otherwise(_rounded(_capped(c("pages") / 10, 60) + _capped(c("deep") / c("n") * 40.0, 40))).alias("intensity"),
        _rounded(F.coalesce(c("ordered") * 50, F.lit(25.0)) + _capped(zero("dives") * 10, 30) + _capped(zero("focused") * 5, 20)).alias("methodology"),
        _rounded(_capped(c("recent") * 7.5, 45) + _capped(c("active") * 10, 30) + _capped(c("almost") * 8, 25)).alias("momentum"),
    )
