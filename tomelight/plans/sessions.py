"""Activity reports over the events table: an event is a session of ``value`` minutes by a user, of a type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import day_islands, dense_days, fractional_hour, shifted
from ..functions.numbers import by_index, clamp, half_up, slope
from .registry import Tables, query


@query("""
WITH h AS (SELECT hour(ts) AS hour, count(*) AS sessions, sum(value) AS minutes FROM events GROUP BY 1)
SELECT CAST(g.hour AS INTEGER) AS hour, coalesce(h.sessions, 0) AS sessions, round(coalesce(h.minutes, 0), 4) AS minutes
FROM range(24) g(hour) LEFT JOIN h ON h.hour = g.hour
""")
def peak_hours(t: Tables):
    """Sessions and minutes by hour of day, all 24 hours."""
    found = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("sessions"), F.sum("value").alias("minutes"))
    hours = t.spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.round(F.coalesce("minutes", F.lit(0.0)), 4).alias("minutes"))


@query("SELECT CAST(hour(ts + INTERVAL 2 HOUR) AS INTEGER) AS hour, count(*) AS sessions FROM events GROUP BY 1")
def peak_hours_shifted(t: Tables):
    """Peak hours on the clock of another time zone."""
    return t.events.groupBy(F.hour(shifted(F.col("ts"), "+02:00")).alias("hour")).agg(F.count("*").alias("sessions"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS sessions, round(sum(value), 4) AS minutes FROM events GROUP BY 1")
def session_heatmap(t: Tables):
    """Sessions a day."""
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query("SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, user_id, count(*) AS sessions FROM events GROUP BY 1, 2, 3")
def monthly_heatmap(t: Tables):
    return t.events.groupBy(F.year("ts").alias("y"), F.month("ts").alias("m"), "user_id").agg(F.count("*").alias("sessions"))


@query("""
SELECT event_id, user_id, event_type, ts, value FROM events
WHERE ts >= (SELECT date_trunc('week', max(ts)) FROM events) AND ts < (SELECT date_trunc('week', max(ts)) + INTERVAL 7 DAY FROM events)
""")
def week_timeline(t: Tables):
    """Sessions of the last week, Monday to Monday, half open."""
    last = t.events.agg(F.date_trunc("week", F.max("ts")).cast("timestamp_ntz").alias("monday"))
    inside = (F.col("ts") >= F.col("monday")) & (F.col("ts") < F.col("monday") + F.expr("interval 7 days"))
    return t.events.join(F.broadcast(last), inside).select("event_id", "user_id", "event_type", "ts", "value")


@query("SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN value > 0 THEN 60.0 / value END), 4) AS speed FROM events GROUP BY 1")
def speed_per_day(t: Tables):
    """Mean rate a day; sessions without duration don't count."""
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg(F.when(F.col("value") > 0, F.lit(60.0) / F.col("value"))), 4).alias("speed"))


@query("""
WITH d AS (SELECT dayofweek(ts) + 1 AS dow, count(*) AS sessions, sum(value) AS minutes FROM events GROUP BY 1)
SELECT CAST(g.dow AS INTEGER) AS dow, coalesce(sessions, 0) AS sessions, round(coalesce(minutes, 0), 4) AS minutes FROM range(1, 8) g(dow) LEFT JOIN d ON d.dow = g.dow
""")
def favourite_days(t: Tables):
    """Sessions by day of week, Sunday is 1, all seven days."""
    found = t.events.groupBy(F.dayofweek("ts").alias("dow")).agg(F.count("*").alias("sessions"), F.sum("value").alias("minutes"))
    days = t.spark.range(1, 8).select(F.col("id").cast("int").alias("dow"))
    return days.join(found, "dow", "left").select("dow", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.round(F.coalesce("minutes", F.lit(0.0)), 4).alias("minutes"))


@query("""
SELECT event_type, count(*) AS sessions, count(DISTINCT user_id) AS users, round(sum(value), 4) AS minutes,
       round(count(*) * 1.0 / count(DISTINCT user_id), 4) AS sessions_per_user
FROM events GROUP BY 1
""")
def genre_stats(t: Tables):
    users = F.countDistinct("user_id")
    return t.events.groupBy("event_type").agg(F.count("*").alias("sessions"), users.alias("users"), F.round(F.sum("value"), 4).alias("minutes"), F.round(F.count("*") / users, 4).alias("sessions_per_user"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM i GROUP BY user_id, island),
m AS (SELECT max(CAST(ts AS DATE)) AS today FROM events)
SELECT user_id, max(length) AS longest, coalesce(max(CASE WHEN last_day >= m.today - 1 THEN length END), 0) AS current, sum(length)::BIGINT AS active_days
FROM r, m GROUP BY user_id
""")
def streaks(t: Tables):
    """Longest run of active days per user, and the run that ends today or yesterday (today: the last day of the data)."""
    days = t.events.select("user_id", F.to_date("ts").alias("day"))
    today = t.events.agg(F.max(F.to_date("ts")).alias("today"))
    runs = day_islands(days, ["user_id"]).join(F.broadcast(today))
    open_ = F.when(F.col("last_day") >= F.date_sub("today", 1), F.col("length"))
    return runs.groupBy("user_id").agg(F.max("length").alias("longest"), F.coalesce(F.max(open_), F.lit(0)).alias("current"), F.sum("length").alias("active_days"))


@query("""
WITH m AS (SELECT max(CAST(ts AS DATE)) AS today FROM events), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(g.day AS DATE) AS day, coalesce(c.n, 0) AS sessions
FROM (SELECT unnest(generate_series(today - 364, today, INTERVAL 1 DAY)) AS day FROM m) g LEFT JOIN c ON c.day = CAST(g.day AS DATE)
""")
def last_365_days(t: Tables):
    """A dense strip of the last 365 days."""
    today = t.events.agg(F.max(F.to_date("ts")).alias("today"))
    days = today.select(F.explode(F.sequence(F.date_sub("today", 364), "today")).alias("day"))
    found = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(found, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sessions"))


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def activity_dates(t: Tables):
    return t.events.select("user_id", F.to_date("ts").alias("day")).distinct()


@query("SELECT event_id, round(hour(ts) + minute(ts) / 60.0, 4) AS hour, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def session_scatter(t: Tables):
    """The newest 500 sessions by fractional hour."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", F.round(fractional_hour(F.col("ts")), 4).alias("hour"), "value")


@query("SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS sessions, round(sum(value), 4) AS minutes FROM events GROUP BY 1, 2")
def item_timeline(t: Tables):
    """First and last session, a bar for each item."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query("SELECT event_id, ts, value FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def sessions_paged(t: Tables):
    """The second page of one user's sessions, newest first."""
    first = t.events.agg(F.min("user_id").alias("user_id"))
    return t.events.join(F.broadcast(first), "user_id", "left_semi").orderBy(F.desc("ts"), "event_id").offset(20).limit(20).select("event_id", "ts", "value")


@query("SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(round(sum(value) / 60.0) AS BIGINT) AS hours FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def listening_heatmap(t: Tables):
    return t.events.where("event_type = 'view'").groupBy(F.year("ts").alias("y"), F.month("ts").alias("m")).agg(F.round(F.sum("value") / 60.0).cast("long").alias("hours"))


@query("SELECT CAST(year(ts) AS INTEGER) AS y, CAST(week(ts) AS INTEGER) AS w, count(*) AS sessions, round(sum(value), 4) AS minutes FROM events GROUP BY 1, 2")
def weekly_trend(t: Tables):
    """ISO weeks under the calendar year, so a week over New Year shows twice."""
    return t.events.groupBy(F.year("ts").alias("y"), F.weekofyear("ts").alias("w")).agg(F.count("*").alias("sessions"), F.round(F.sum("value"), 4).alias("minutes"))


@query("SELECT CAST(isoyear(ts) AS INTEGER) AS y, CAST(week(ts) AS INTEGER) AS w, count(*) AS sessions FROM events GROUP BY 1, 2")
def weekly_trend_iso(t: Tables):
    """ISO weeks under the ISO year."""
    return t.events.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("int").alias("y"), F.weekofyear("ts").alias("w")).agg(F.count("*").alias("sessions"))


@query("""
WITH u AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1), a AS (SELECT max(value) AS everything FROM events)
SELECT count(*) AS items, count(*) FILTER (top / everything >= 0.98) AS finished, round(count(*) FILTER (top / everything >= 0.98) * 100.0 / count(*), 4) AS rate FROM u, a
""")
def completion_rate(t: Tables):
    """Items whose furthest progress is 98 % or more."""
    everything = t.events.agg(F.max("value").alias("everything"))
    done = F.count_if(F.col("top") / F.col("everything") >= 0.98)
    users = t.events.groupBy("user_id").agg(F.max("value").alias("top")).join(F.broadcast(everything))
    return users.agg(F.count("*").alias("items"), done.alias("finished"), F.round(done * 100.0 / F.count("*"), 4).alias("rate"))


@query("""
WITH a AS (SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, count(DISTINCT user_id) AS started FROM events GROUP BY 1, 2),
b AS (SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, count(*) AS finished FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT a.y, a.m, started, coalesce(finished, 0) AS finished FROM a LEFT JOIN b ON a.y = b.y AND a.m = b.m
""")
def monthly_pace(t: Tables):
    by = [F.year("ts").alias("y"), F.month("ts").alias("m")]
    started = t.events.groupBy(*by).agg(F.countDistinct("user_id").alias("started"))
    finished = t.events.where("event_type = 'purchase'").groupBy(*by).agg(F.count("*").alias("finished"))
    return started.join(finished, ["y", "m"], "left").select("y", "m", "started", F.coalesce("finished", F.lit(0)).alias("finished"))


@query("""
WITH u AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1)
SELECT count(*) AS started, count(*) FILTER (top >= 25) AS quarter, count(*) FILTER (top >= 50) AS half, count(*) FILTER (top >= 75) AS most, count(*) FILTER (n >= 100) AS regular FROM u
""")
def finish_funnel(t: Tables):
    users = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return users.agg(F.count("*").alias("started"), *[F.count_if(F.col("top") >= p).alias(a) for a, p in (("quarter", 25), ("half", 50), ("most", 75))], F.count_if(F.col("n") >= 100).alias("regular"))


@query("SELECT user_id, round(sum(value), 4) AS minutes, count(*) AS sessions FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 10")
def longest_items(t: Tables):
    return t.events.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("sessions")).orderBy(F.desc("total"), "user_id").limit(10).select("user_id", F.round("total", 4).alias("minutes"), "sessions")


@query("""
WITH s AS (SELECT user_id, ts, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n,
                  date_sub('second', lag(ts) OVER w, ts) // 3600 AS gap
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, n, coalesce(regr_slope(value, k), 0) AS accel, coalesce(regr_slope(gap, k), 0) AS gaps,
             avg(value) FILTER (k > floor(n * 0.75)) AS late, avg(value) FILTER (k <= floor(n * 0.75)) AS early
      FROM s GROUP BY user_id, n)
SELECT user_id, n AS sessions,
       round(35 * greatest(0, least(1, accel)) + 35 * greatest(0, least(1, -gaps)) + CASE WHEN late > early THEN 30 ELSE 0 END, 3) AS grip
FROM g WHERE n >= 5
""")
def page_turner(t: Tables):
    """Grip: sessions grow longer, gaps shrink, and the last quarter beats the rest."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count("*").over(Window.partitionBy("user_id"))
    gap = F.floor(F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts")) / 3600)
    s = t.events.select("user_id", "value", F.row_number().over(order).alias("k"), n.alias("n"), gap.alias("gap"))
    late = F.col("k") > F.floor(F.col("n") * 0.75)
    g = s.groupBy("user_id", "n").agg(
        slope(F.col("value"), F.col("k")).alias("accel"), slope(F.col("gap"), F.col("k")).alias("gaps"), F.avg(F.when(late, F.col("value"))).alias("late"), F.avg(F.when(~late, F.col("value"))).alias("early")
    )
    burst = F.when(F.col("late") > F.col("early"), 30).otherwise(0)
    return g.where("n >= 5").select("user_id", F.col("n").alias("sessions"), F.round(35 * clamp(F.col("accel"), 0.0, 1.0) + 35 * clamp(-F.col("gaps"), 0.0, 1.0) + burst, 3).alias("grip"))


@query("""
WITH s AS (SELECT *, dense_rank() OVER (ORDER BY user_id DESC) AS r FROM events)
SELECT user_id, event_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS progress FROM s WHERE r <= 10
""")
def completion_race(t: Tables):
    """Running progress of the ten items with the highest ids."""
    top = t.events.select("user_id").distinct().orderBy(F.desc("user_id")).limit(10)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.join(F.broadcast(top), "user_id").select("user_id", "event_id", "ts", F.round(F.sum("value").over(order), 4).alias("progress"))


@query("""
WITH q AS (SELECT list_sort(list(value)) AS v FROM events),
b AS (SELECT v[CAST(floor(len(v) * 0.25) AS INTEGER) + 1] AS q1, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS q2, v[CAST(floor(len(v) * 0.75) AS INTEGER) + 1] AS q3 FROM q)
SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part,
       CASE WHEN value <= q1 THEN 'short' WHEN value <= q3 THEN 'medium' WHEN value <= q3 + 1.5 * (q3 - q1) THEN 'long' ELSE 'marathon' END AS kind, count(*) AS sessions
FROM events, b GROUP BY 1, 2
""")
def session_archetypes(t: Tables):
    """Part of day by length class; classes from exact quartiles and the upper fence.

    Quartiles come from ranks (a global sort and one row a quartile), not from an array of all values.
    """
    n = t.events.count()
    bounds = _order_statistics(t, n, (0.25, 0.75))
    h, v, fence = F.hour("ts"), F.col("value"), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    kind = F.when(v <= F.col("q1"), "short").when(v <= F.col("q3"), "medium").when(v <= fence, "long").otherwise("marathon")
    return t.events.join(F.broadcast(bounds)).groupBy(part.alias("part"), kind.alias("kind")).agg(F.count("*").alias("sessions"))


def _order_statistics(t: Tables, n: int, shares: tuple[float, ...]):
    """sorted[floor(n * share)] of value: one row with q1 and q3, from counts of distinct values."""
    counts = t.events.groupBy("value").agg(F.count("*").alias("c"))
    running = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    totals = running.groupBy("part").agg(F.sum("c").alias("s"))
    before = totals.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    order = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = running.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(order))
    places = [int(n * s) + 1 for s in shares]
    return ranked.agg(*[F.min(F.when(F.col("upto") >= p, F.col("value"))).alias(a) for p, a in zip(places, ("q1", "q3"), strict=True)])


@query("""
WITH s AS (SELECT event_id, user_id, ts AS a, ts + to_minutes(CAST(floor(value * 10) AS BIGINT)) AS b FROM events WHERE value > 0),
d AS (SELECT event_id, user_id, a, b, unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS day FROM s)
SELECT event_id, user_id, CAST(day AS DATE) AS day, greatest(a, day) AS from_ts, least(b, day + INTERVAL 1 DAY) AS to_ts
FROM d WHERE greatest(a, day) < least(b, day + INTERVAL 1 DAY)
""")
def sessions_by_day(t: Tables):
    """Sessions that run over midnight, split at midnight."""
    end = F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 10).cast("int"))
    s = t.events.where("value > 0").select("event_id", "user_id", F.col("ts").alias("a"), end.alias("b"))
    d = s.select("*", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    midnight = F.col("day").cast("timestamp_ntz")
    out = d.select("event_id", "user_id", "day", F.greatest("a", midnight).alias("from_ts"), F.least("b", midnight + F.expr("interval 1 day")).alias("to_ts"))
    return out.where("from_ts < to_ts")


@query("""
WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS events, round(sum(value), 4) AS minutes, date_sub('second', min(ts), max(ts)) AS seconds
FROM s GROUP BY user_id, k
""")
def captured_sessions(t: Tables):
    """Events grouped into sessions that end after five idle minutes (session_window)."""
    w = F.session_window(F.col("ts"), "5 minutes 1 microsecond")
    s = t.events.groupBy("user_id", w).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("minutes"))
    return s.select("user_id", "first_ts", "events", "minutes", F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")).alias("seconds"))


@query("""
WITH h AS (SELECT count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 5) AS night, count(*) FILTER (hour(ts) BETWEEN 5 AND 10) AS morning, count(*) AS n FROM events)
SELECT night, morning, CASE WHEN night > morning * 1.2 THEN 'night owl' WHEN morning > night * 1.2 THEN 'early bird' ELSE 'balanced' END AS kind FROM h
""")
def reading_clock(t: Tables):
    h = F.hour("ts")
    x = t.events.agg(F.count_if((h >= 22) | (h < 5)).alias("night"), F.count_if(h.between(5, 10)).alias("morning"))
    return x.select("night", "morning", F.when(F.col("night") > F.col("morning") * 1.2, "night owl").when(F.col("morning") > F.col("night") * 1.2, "early bird").otherwise("balanced").alias("kind"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, round(stddev_pop(v) / avg(v), 4) AS variation, round(100.0 * count(*) / (date_diff('day', min(day), max(day)) + 1), 4) AS consistency FROM d GROUP BY 1
""")
def reading_habits(t: Tables):
    """Coefficient of variation of daily minutes, and active days against the span."""
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    span = F.date_diff(F.max("day"), F.min("day")) + 1
    return d.groupBy("user_id").agg(F.round(F.stddev_pop("v") / F.avg("v"), 4).alias("variation"), F.round(F.lit(100.0) * F.count("*") / span, 4).alias("consistency"))


@query("""
WITH u AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1), x AS (SELECT unnest([0, 10, 25, 50, 75, 90, 99]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (top >= threshold) * 100.0 / count(*) AS share FROM u, x GROUP BY 1)
SELECT threshold, round(share, 4) AS share, round(coalesce(lag(share) OVER (ORDER BY threshold) - share, 0), 4) AS fall FROM c
""")
def survival_curve(t: Tables):
    """Share of items that reach each threshold, and the fall from the one before."""
    marks = (0, 10, 25, 50, 75, 90, 99)
    u = t.events.groupBy("user_id").agg(F.max("value").alias("top"))
    row = u.agg(F.count("*").alias("n"), *[F.count_if(F.col("top") >= m).alias(f"c{m}") for m in marks])
    curve = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("threshold"), (F.col(f"c{m}") * 100.0 / F.col("n")).alias("share")) for m in marks])).alias("x")).select("x.*")
    return curve.select("threshold", F.round("share", 4).alias("share"), F.round(F.coalesce(F.lag("share").over(Window.orderBy("threshold")) - F.col("share"), F.lit(0.0)), 4).alias("fall"))


@query("""
WITH f AS (SELECT event_type, floor(value * 100 + 0.5) / 100 AS v FROM events)
SELECT event_type, round(sum(v), 4) AS total, CAST(round(sum(v) / 60.0) AS BIGINT) AS hours FROM f GROUP BY 1
""")
def rounded_totals(t: Tables):
    return t.events.select("event_type", half_up(F.col("value"), 2).alias("v")).groupBy("event_type").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.sum("v") / 60.0).cast("long").alias("hours"))


@query("""
WITH r AS (SELECT event_type, user_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type, ts, value FROM r WHERE k = 1
""")
def latest_progress(t: Tables):
    """Last writer wins: the newest row of each key, by an aggregate and without a window."""
    x = t.events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("x"))
    return x.select("user_id", "event_type", "x.ts", "x.value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def event_properties(t: Tables):
    """A field of the JSON properties."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def quartiles_of(values):
    """(q1, q3) of an array column by index."""
    return by_index(values, 0.25), by_index(values, 0.75)


__all__ = ["dense_days", "quartiles_of"]
