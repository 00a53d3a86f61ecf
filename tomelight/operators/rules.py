"""Declarative rules compiled to Spark columns.

A rule tree is JSON or a dict: groups ``{"type": "group", "join": "and"|"or", "rules": [...]}`` of leaves
``{"field", "operator", "value", "valueStart", "valueEnd"}``. A schema says which column each field is and of what kind
(text, number, date, flag, list). Every leaf is two-valued (never null), so negation needs no null rule.

Two dialects, ``default`` and ``lenient``. They differ so:

| case | default | lenient |
|-|-|-|
| empty group | true under "and", false under "or" | true |
| unreadable leaf | false | skipped |
| > >= < <= on an instant field | compares | true |
| a field of a file | its primary file | any file (``Field.lenient``, a list) |
| is_empty of a field of a progress row | whether there is the row (``Field.present``) | whether the value is blank |
| not_equals of a series field, book without series | false | true |
| what a series field says of a series | ``Field.column`` | ``Field.lenient`` |
| includes_all on a single value, two or more distinct values | false | as includes_any |
| scalar operators on an id list | the list's | true |

A join other than "and" means "or". Invalid JSON and groups nested deeper than MAX_DEPTH match nothing.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 64

#: The operators of the rule language.
OPERATORS = (
    "equals not_equals contains does_not_contain starts_with ends_with greater_than greater_than_equal_to less_than less_than_equal_to in_between "
    "is_empty is_not_empty includes_any includes_all excludes_all within_last older_than this_period"
).split()


LISTED = ("list", "ids", "series")


class Unreadable(ValueError):
    """A leaf whose field, operator or value makes no sense."""


@dataclass(frozen=True)
class Field:
    column: Column
    #: text, number, date, instant, flag, list, ids (a list of ids) or series (a list of what holds for the book's series)
    kind: str
    #: What the lenient dialect reads instead: for text and number the list of all files' values, for series another list.
    lenient: Column | None = None
    #: Whether there is a row that can hold the value; for series, whether the book is in one.
    present: Column | None = None


def _text(value) -> str:
    return ("" if value is None else str(value)).lower()


def _number(value) -> float:
    if value is None or value == "":
        return 0.0
    if isinstance(value, bool):
        return float(value)
    try:
        return float(value)
    except (TypeError, ValueError) as error:
        raise Unreadable(f"not a number: {value!r}") from error


def _moment(value) -> datetime.datetime:
    try:
        found = datetime.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError as error:
        raise Unreadable(f"not a date: {value!r}") from error
    return found.replace(tzinfo=None)


def _values(value) -> list:
    return list(value) if isinstance(value, list) else [value]


def _lit(field: Field, value) -> Column:
    if field.kind == "number":
        return F.lit(_number(value))
    if field.kind in ("date", "instant"):
        return F.lit(_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")
    if field.kind == "flag":
        return F.lit(str(value).lower() == "true")
    return F.lit(_text(value))


def _plain(field: Field) -> Column:
    return F.lower(field.column) if field.kind == "text" else field.column


def _list(field: Field) -> Column:
    """The field as an array of lower-cased texts without nulls; a null list is empty, a scalar has one element."""
    if field.kind in LISTED:
        return F.coalesce(F.array_compact(F.transform(field.column.cast("array<string>"), F.lower)), F.array().cast("array<string>"))
    return F.array_compact(F.array(F.lower(field.column.cast("string"))))


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _back(now: datetime.datetime, amount: int, unit: str) -> datetime.datetime:
    if unit in ("days", "weeks"):
        return now - datetime.timedelta(days=amount * (7 if unit == "weeks" else 1))
    months = now.year * 12 + now.month - 1 - amount * (12 if unit == "years" else 1)
    year, month = divmod(months, 12)
    last = (datetime.date(year + month // 11, (month + 1) % 12 + 1, 1) - datetime.timedelta(1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last), hour=0, minute=0, second=0, microsecond=0)


def _period(now: datetime.datetime, unit: str) -> datetime.datetime:
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    starts = {"week": day - datetime.timedelta(day.weekday()), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}
    if unit not in starts:
        raise Unreadable(f"no such period: {unit!r}")
    return starts[unit]


SCALAR = ("equals", "not_equals", "contains", "does_not_contain", "starts_with", "ends_with", "greater_than", "greater_than_equal_to", "less_than", "less_than_equal_to", "in_between")
COMPARING = ("greater_than", "greater_than_equal_to", "less_than", "less_than_equal_to")


def leaf(rule: dict, schema: dict[str, Field], now: datetime.datetime, dialect: str = "default") -> Column:
    """One leaf as a column: two-valued, or in the lenient dialect three-valued where a scalar field is null."""
    field, operator, value = schema.get(rule.get("field")), rule.get("operator"), rule.get("value")
    if field is None or operator not in OPERATORS:
        raise Unreadable(f"{rule.get('field')} {operator}")
    if dialect == "lenient":
        if operator in COMPARING and field.kind == "instant" or operator in SCALAR and field.kind == "ids":
            return F.lit(True)
        if field.lenient is not None and field.kind == "series":
            field = Field(field.lenient, "series", None, field.present)
        elif field.lenient is not None:
            # some file's value meets the leaf
            return F.coalesce(F.exists(field.lenient, lambda x: leaf(rule, {rule["field"]: Field(x, field.kind)}, now)), F.lit(False))
        if operator == "includes_all" and field.kind not in LISTED:
            operator = "includes_any"
    elif field.present is not None and operator in ("is_empty", "is_not_empty") and field.kind != "series":
        there = F.coalesce(field.present, F.lit(False))
        return ~there if operator == "is_empty" else there
    plain, listed = _plain(field), field.kind in LISTED
    # the lenient dialect is SQL's own: a test of an unknown value is unknown, and so is its negation
    sure = _sure if dialect == "default" or listed else (lambda test: test)
    if operator in ("equals", "not_equals"):
        if listed:
            test = _sure(F.array_contains(_list(field), _text(value)))
            if field.kind == "series" and operator == "not_equals" and dialect == "default":
                return ~test & F.coalesce(field.present, F.lit(False))
        else:
            test = plain.isNull() if value is None else plain.eqNullSafe(_lit(field, value)) if dialect == "default" else plain == _lit(field, value)
            if dialect == "lenient" and operator == "not_equals" and rule["field"] == "readStatus" and value != "UNSET":
                return plain.isNull() | ~test  # a book without a status has another one
        return test if operator == "equals" else ~test
    if operator in ("contains", "does_not_contain", "starts_with", "ends_with"):
        name = {"starts_with": "startswith", "ends_with": "endswith"}.get(operator, "contains")
        wanted = _text(value)
        if listed:
            test = F.exists(_list(field), lambda x: getattr(x, name)(wanted))
        else:
            test = sure(getattr(plain, name)(wanted)) if field.kind == "text" else F.lit(False)
        return ~test if operator == "does_not_contain" else test
    if operator in ("greater_than", "greater_than_equal_to", "less_than", "less_than_equal_to"):
        if field.kind not in ("number", "date", "instant"):
            raise Unreadable(f"{operator} on {field.kind}")
        other = _lit(field, value)
        tests = {"greater_than": plain > other, "greater_than_equal_to": plain >= other, "less_than": plain < other, "less_than_equal_to": plain <= other}
        return sure(tests[operator])
    if operator == "in_between":
        if field.kind not in ("number", "date", "instant"):
            raise Unreadable(f"{operator} on {field.kind}")
        return sure(plain.between(_lit(field, rule.get("valueStart")), _lit(field, rule.get("valueEnd"))))
    if operator in ("is_empty", "is_not_empty"):
        if listed:
            empty = F.coalesce(F.size(field.column) <= 0, F.lit(True))
        elif field.kind == "text":
            empty = F.coalesce(F.length(F.regexp_replace(field.column, r"[\s ﻿]", "")) == 0, F.lit(True))
        else:
            empty = field.column.isNull()
        return empty if operator == "is_empty" else ~empty
    if operator in ("includes_any", "includes_all", "excludes_all"):
        wanted = F.array(*[F.lit(_text(v)) for v in _values(value) if v is not None]).cast("array<string>")
        if operator == "includes_all":
            return F.size(F.array_except(wanted, _list(field))) == 0
        test = _sure(F.arrays_overlap(_list(field), wanted))
        if dialect == "lenient" and not listed:
            unset = operator == "excludes_all" and rule["field"] == "readStatus" and "UNSET" not in _values(value)
            test = F.when(plain.isNull(), F.lit(False) if unset else None).otherwise(test)
        return ~test if operator == "excludes_all" else test
    if field.kind not in ("date", "instant"):
        raise Unreadable(f"{operator} on {field.kind}")
    unit = str(rule.get("valueEnd") or "days")
    if operator == "this_period":
        edge = _period(now, str(value))
    else:
        edge = _back(now, int(_number(value)), unit)
    limit = F.lit(edge.isoformat(sep=" ")).cast("timestamp_ntz")
    return _sure(field.column < limit if operator == "older_than" else field.column >= limit)


def compile_rule(rule: str | dict, schema: dict[str, Field], now: datetime.datetime, dialect: str = "default") -> Column:
    """A rule tree as one column: ``df.where(compile_rule(...))``. The default dialect's is two-valued; the lenient one's keeps nulls through groups, as SQL does."""
    if isinstance(rule, str):
        try:
            rule = json.loads(rule)
        except ValueError:
            return F.lit(False)
    if not isinstance(rule, dict):
        return F.lit(False)

    def group(node: dict, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise RecursionError
        both = node.get("join") == "and"
        tests = []
        for child in node.get("rules") or []:
            if child.get("type") == "group" or "rules" in child:
                tests.append(group(child, depth + 1))
                continue
            try:
                tests.append(leaf(child, schema, now, dialect))
            except Unreadable:
                if dialect == "default":
                    tests.append(F.lit(False))
        if not tests:
            return F.lit(both or dialect == "lenient")
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), tests)

    try:
        return group(rule, 1)
    except RecursionError:
        return F.lit(False)


#: Names that a presence rule knows. A text must not be blank, a list not empty, anything else not null.
PRESENCE = (
    "thumbnailUrl personalRating audiobookDuration authors categories moods tags comicCharacters comicTeams comicLocations comicPencillers comicInkers comicColorists comicLetterers comicCoverArtists comicEditors "
    "title subtitle description publisher language seriesName isbn13 isbn10 asin contentRating narrator goodreadsId hardcoverId googleId audibleId lubimyczytacId ranobedbId comicvineId "
    "pageCount seriesNumber seriesTotal ageRating publishedDate abridged amazonRating goodreadsRating hardcoverRating ranobedbRating lubimyczytacRating audibleRating "
    "amazonReviewCount goodreadsReviewCount hardcoverReviewCount audibleReviewCount"
).split()
#: Columns whose names don't follow from these.
_COLUMNS = {"thumbnailUrl": "cover", "publishedDate": "published", "comicCharacters": "characters", "comicTeams": "teams", "comicLocations": "locations"}
_COLUMNS |= {f"comic{n}s": n[0].lower() + n[1:] if n != "CoverArtist" else "cover_artist" for n in ("Penciller", "Inker", "Colorist", "Letterer", "CoverArtist", "Editor")}
#: The sources of a book's reading progress.
PROGRESS = ("koreader_progress", "kobo_progress", "pdf_progress", "epub_progress", "cbx_progress")


def column_of(name: str) -> str:
    """The column of a presence name: seriesName is series_name."""
    return _COLUMNS.get(name) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def presence(rows: DataFrame) -> Column:
    """The presence names of which a row says something, as a list; names without a column in rows are never there."""
    kinds, there = dict(rows.dtypes), []
    for name in PRESENCE:
        kind, column = kinds.get(column_of(name)), F.col(column_of(name))
        if kind is not None:
            test = F.size(column) > 0 if kind.startswith("array") else F.trim(column) != "" if kind == "string" else column.isNotNull()
            there.append(F.when(F.coalesce(test, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*there)) if there else F.array().cast("array<string>")


def reading_progress(sources: tuple[str, ...] = PROGRESS) -> Column:
    """The furthest of a book's sources of progress; 0 where none has any."""
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in sources])


def series_states(books: DataFrame, id_column: str, series: Column, number: Column, status: Column, total: Column | None = None) -> DataFrame:
    """books with what holds for each one's series, as lists of names: series_status, series_gaps, series_position, and what the lenient
    dialect reads, lenient_status and lenient_gaps; and in_series.

    status is null where the book has no progress row. One aggregate a series, joined back.
    """
    key, whole = F.nullif(F.trim(series), F.lit("")), F.floor(number).cast("long")
    total = F.lit(None).cast("long") if total is None else total
    read = F.coalesce(status == "READ", F.lit(False))
    x = books.withColumns({"_series": key, "_number": number, "_whole": whole, "_read": read, "_other": status.isNotNull() & ~read, "_total": total, "_going": F.coalesce(status == "READING", F.lit(False))})
    s = x.where("_series is not null").groupBy("_series").agg(
        F.bool_and("_read").alias("every"), F.bool_or("_read").alias("some"), F.bool_or("_other").alias("other"), F.bool_or("_going").alias("going"), F.min("_whole").alias("low"), F.max("_whole").alias("high"),
        F.count_distinct("_whole").alias("kinds"), F.count("_whole").alias("numbered"), F.max("_total").alias("most"), F.min("_number").alias("first_no"), F.max("_number").alias("last_no"),
        F.min(F.when(~F.col("_read"), F.col("_number"))).alias("next_no"),
    )
    named = lambda *tests: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests]))
    c = F.col
    gaps = (("any_gap", c("high") - c("low") + 1 > c("kinds")), ("missing_latest", c("most") > c("high")), ("duplicate_number", c("numbered") > c("kinds")))
    going = (("reading", c("going") | (c("some") & ~c("every"))), ("not_started", ~c("some") & ~c("going")), ("completed", c("most") <= c("high")), ("ongoing", c("most") > c("high")))
    s = s.select(
        "_series", "first_no", "last_no", "next_no", named(("fully_read", c("every")), *going).alias("series_status"), named(("fully_read", c("some") & ~c("other")), *going).alias("lenient_status"),
        named(("missing_first", c("low") > 1), *gaps).alias("series_gaps"), named(("missing_first", (c("low") > 1) | c("low").isNull()), *gaps).alias("lenient_gaps"),
    )
    none = F.array().cast("array<string>")
    joined = x.join(s, "_series", "left")
    place = named(("first_in_series", c("_number") == c("first_no")), ("last_in_series", c("_number") == c("last_no")), ("next_unread", (c("_number") == c("next_no")) & ~c("_read")))
    lists = [F.coalesce(n, none).alias(n) for n in ("series_status", "lenient_status", "series_gaps", "lenient_gaps")]
    return joined.select(*[joined[n] for n in books.columns], *lists, F.coalesce(place, none).alias("series_position"), c("_series").isNotNull().alias("in_series"))
