"""Calendar helpers as columns: shifts, islands of days, dense calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shifted(ts: Column, offset: str) -> Column:
    """Wall-clock time at an offset such as '+02:00' for a UTC timestamp_ntz."""
    return F.convert_timezone(F.lit("UTC"), F.lit(offset), ts)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def iso_week_bounds(year: int, week: int) -> tuple[str, str]:
    """[Monday, next Monday) of an ISO week, as dates."""
    import datetime

    monday = datetime.date.fromisocalendar(year, week, 1)
    return monday.isoformat(), (monday + datetime.timedelta(7)).isoformat()


def free_text_year(text: Column, last: Column | int) -> Column:
    """First four digits of a text as a year, if 1000 to ``last``."""
    year = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d{4})"), F.lit(1)), F.lit(1)).cast("int")
    return F.when(year.between(1000, last), year)


def decade(year: Column) -> Column:
    """Ten-year bucket; before 1900 is one bucket, 2020 and later is one."""
    return F.when(year < 1900, F.lit("before 1900")).when(year >= 2020, F.lit("2020s")).otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def day_islands(days: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days per key: by, first_day, last_day, length. Input days may repeat."""
    distinct = days.select(*by, day).distinct()
    order = Window.partitionBy(*by).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(order))
    return distinct.withColumn("island", island).groupBy(*by, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("island")


def dense_days(spark, last: Column, count: int) -> DataFrame:
    """The ``count`` days that end with ``last`` (a literal column), one row each."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, count - 1), last)).alias("day"))
