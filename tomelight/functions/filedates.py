"""File-name patterns with typed fields and dates, and names that fit a file system's limits, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: What each placeholder of a file-name pattern accepts.
ACCEPTS = {
    "SeriesName": "(.+?)", "Title": "(.+?)", "Subtitle": "(.+?)", "Authors": "(.+?)", "SeriesNumber": r"(\d+(?:\.\d+)?)", "Published": "(.+?)", "Publisher": "(.+?)", "Language": "([a-zA-Z]+)",
    "SeriesTotal": r"(\d+)", "ISBN10": r"(\d{9}[0-9Xx])", "ISBN13": "([0-9]{13})", "ASIN": r"(B[A-Za-z0-9]{9}|\d{9}[0-9Xx])",
}
#: The parts of a date form, longest first.
FORMS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}"}
#: Bytes of a path's part and of an author list, and what a cut list ends with.
COMPONENT_BYTES, AUTHOR_BYTES, AND_OTHERS = 245, 180, " et al."
LONGEST_EXTENSION = 50
_PLACEHOLDER = re.compile(r"\{(\w+)(?::(.*?))?\}|\*")
_FORM = re.compile("|".join(FORMS) + "|.", re.S)


def _form_regex(form: str, grouped: bool = False) -> str:
    """A date form as a regular expression; grouped: with a group for each of its parts."""
    wrap = "({})" if grouped else "{}"
    return "".join(wrap.format(FORMS[p]) if p in FORMS else re.escape(p) for p in _FORM.findall(form))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers: null if a month or day can't be; a day beyond its month's end is the last one."""
    first = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")).try_cast("date")
    wanted = F.when(month.between(1, 12) & day.between(1, 31) & year.between(1, 9999), day)
    return F.when(wanted.isNotNull(), F.date_add(first, F.least(wanted, F.dayofmonth(F.last_day(first))) - 1))


def date_by_form(text: Column, form: str) -> Column:
    """The date that a text gives in a form of yyyy, yy, MM, M, dd and d; parts that are missing are 1. A year of two figures is of this
    century, but alone it is of the last one from 50 on."""
    parts = [p for p in _FORM.findall(form) if p in FORMS]
    regex = f"^{_form_regex(form, True)}$"
    value = {p[0]: F.regexp_extract(F.trim(text), regex, i + 1).try_cast("int") for i, p in enumerate(parts)}
    if "y" not in value:
        return F.lit(None).cast("date")
    year = value["y"]
    if "yyyy" not in parts:
        year = year + (F.when(year < 50, 2000).otherwise(1900) if parts == ["yy"] else F.lit(2000))
    one = F.lit(1)
    return F.when(F.trim(text).rlike(regex), _date(year, value.get("M", one), value.get("d", one)))


def any_date(text: Column) -> Column:
    """The date of a text without a stated form: a year, 8 figures, year and month either way, or three parts with one separator, of
    which a part of four figures or over 31 is the year, and the day comes before the month where both can be one, unless the year leads."""
    flexible = r"^(\d{1,4})([^\d])(\d{1,2})\2(\d{1,4})$"

    def read(t: Column) -> Column:
        part = lambda regex, i: F.regexp_extract(t, regex, i)
        number = lambda c: c.try_cast("int")
        one, year_month, month_year = F.lit(1), r"^(\d{4})([^\d])(\d{1,2})$", r"^(\d{1,2})([^\d])(\d{4})$"
        p = [part(flexible, i) for i in (1, 3, 4)]
        v = [number(x) for x in p]
        is_year = lambda i: (F.length(p[i]) == 4) | (v[i] > 31)
        # a year is written with four figures or two
        year = lambda i: F.when(F.length(p[i]) == 4, v[i]).when(F.length(p[i]) == 2, v[i] + 2000)
        led = F.when((v[2] <= 12) & (v[1] > 12), _date(year(0), v[2], v[1])).otherwise(_date(year(0), v[1], v[2]))
        ended = F.when((v[0] <= 12) & (v[1] > 12), _date(year(2), v[0], v[1])).otherwise(_date(year(2), v[1], v[0]))
        short = _date(F.when(F.length(p[2]) == 2, v[2] + 2000).otherwise(v[2]), v[1], v[0])
        three = F.when(is_year(0), led).when(is_year(2), ended).otherwise(short)
        letter = part(flexible, 2).rlike(r"[A-Za-z]") | part(year_month, 2).rlike(r"[A-Za-z]") | part(month_year, 2).rlike(r"[A-Za-z]")
        eight = r"^(\d{4})(\d{2})(\d{2})$"
        return (
            F.when(t.rlike(r"^\d{4}$"), _date(number(t), one, one))
            .when(t.rlike(r"^\d{2}$"), date_by_form(t, "yy"))
            .when(t.rlike(eight), _date(*(number(part(eight, i)) for i in (1, 2, 3))))
            .when(letter, None)  # no separator of dates
            .when(t.rlike(year_month), _date(number(part(year_month, 1)), number(part(year_month, 3)), one))
            .when(t.rlike(month_year), _date(number(part(month_year, 3)), number(part(month_year, 1)), one))
            .when(t.rlike(flexible), three)
        )

    return let(F.trim(text), read)


def parsed_pattern(pattern: str) -> tuple[str, list[tuple[str, str | None]]]:
    """``{Title} - {Authors} ({Published:yyyy-MM})`` -> (regular expression, (placeholder, date form) in order); * skips text. The last
    placeholder takes all that is left if nothing follows it."""
    out, names, last = [], [], 0
    found = list(_PLACEHOLDER.finditer(pattern))
    for i, m in enumerate(found):
        out.append(re.escape(pattern[last : m.start()]))
        name, form = ("*", None) if m[0] == "*" else (m[1], m[2])
        ends = i == len(found) - 1 and m.end() == len(pattern)
        accepts = f"({_form_regex(form)})" if name == "Published" and form is not None else ACCEPTS.get(name, "(.+?)")
        out.append("(.+)" if ends and accepts == "(.+?)" else accepts)
        names.append((name, form))
        last = m.end()
    return "^" + "".join(out) + re.escape(pattern[last:]) + "$", names


def pattern_fields(name: Column, pattern: str) -> Column:
    """A struct of the fields that a pattern finds in a base name, typed: Authors an array (split at , ; &), SeriesNumber and SeriesTotal
    numbers, Published a date, the others texts; blank ones null. Null where the name doesn't match as a whole."""
    regex, names = parsed_pattern(pattern)
    fields = []
    for i, (field, form) in enumerate(names):
        if field == "*":
            continue
        value = F.nullif(F.trim(F.regexp_extract(name, regex, i + 1)), F.lit(""))
        if field == "Authors":
            value = F.filter(F.transform(F.split(value, r"[,;&]"), lambda a: F.trim(a)), lambda a: a != "")
        elif field == "SeriesNumber":
            value = value.try_cast("float")
        elif field == "SeriesTotal":
            value = value.try_cast("int")
        elif field == "Published":
            value = date_by_form(value, form) if form and form.strip() else any_date(value)
        fields.append(value.alias(field))
    return F.when(name.rlike(regex), F.struct(*fields))


def within_bytes(text: Column, most: Column | int) -> Column:
    """A text cut to ``most`` bytes of UTF-8 between two characters as a reader sees them (a letter keeps its marks; one that is longer
    alone is cut where the bytes run out), without white space or joiners at the end of the cut."""
    most = F.lit(most) if isinstance(most, int) else most

    def taken(parts: Column) -> Column:
        start = F.struct(F.lit("").alias("kept"), F.lit(True).alias("on"))

        def step(s: Column, part: Column) -> Column:
            fits = s["on"] & (F.octet_length(s["kept"]) + F.octet_length(part) <= most)
            return F.struct(F.when(fits, F.concat(s["kept"], part)).otherwise(s["kept"]).alias("kept"), fits.alias("on"))

        return F.aggregate(parts, start, step, lambda s: s["kept"])

    # no more characters than bytes can be kept
    seen = F.substring(text, F.lit(1), most + 1)
    whole = taken(F.regexp_extract_all(seen, F.lit(r"(?s)\X"), F.lit(0)))
    cut = let(whole, lambda w: F.when(w == "", taken(F.filter(F.split(seen, ""), lambda c: c != ""))).otherwise(w))
    return F.when(F.octet_length(text) > most, F.regexp_replace(cut, r"[\s\p{Z}\x{200C}\x{200D}]+$", "")).otherwise(text)


def component_within(part: Column, last: Column | bool = False, most: int = COMPONENT_BYTES) -> Column:
    """A path's part that a file system takes: cut to ``most`` bytes, a last one before its extension; folders lose dots at their end."""
    last = F.lit(last) if isinstance(last, bool) else last
    extension = F.regexp_extract(part, r"(?s)^.+(\.[^.]*)$", 1)
    name = F.regexp_replace(part, r"(?s)^(.+)\.[^.]*$", "$1")
    named = (extension != "") & (F.octet_length(extension) <= LONGEST_EXTENSION)
    file = F.when(named, F.concat(within_bytes(name, F.lit(most) - F.octet_length(extension)), extension)).otherwise(within_bytes(part, most))
    return F.when(last & part.contains("."), file).otherwise(F.regexp_replace(within_bytes(part, most), r"\.+$", ""))


def path_within(path: Column, most: int = COMPONENT_BYTES) -> Column:
    """A path whose parts all fit; empty ones are left out."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return let(parts, lambda ps: F.array_join(F.transform(ps, lambda p, i: component_within(p, i == F.size(ps) - 1, most)), "/"))


def authors_within(authors: Column, most: int = AUTHOR_BYTES) -> Column:
    """Names separated by ", " as far as ``most`` bytes go, then " et al."; a first name that is too long is cut."""
    suffix = len(AND_OTHERS.encode())
    start = F.struct(F.lit("").alias("kept"), F.lit(True).alias("on"))

    def step(s: Column, name: Column) -> Column:
        longer = F.when(s["kept"] == "", name).otherwise(F.concat_ws(", ", s["kept"], name))
        fits = s["on"] & (F.octet_length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(s["kept"]).alias("kept"), fits.alias("on"))

    names = F.split(authors, ", ")
    kept = F.aggregate(names, start, step, lambda s: F.when(s["kept"] == "", within_bytes(F.element_at(names, 1), most - suffix)).otherwise(s["kept"]))
    return F.when(F.octet_length(authors) > most, F.concat(kept, F.lit(AND_OTHERS))).otherwise(authors)
