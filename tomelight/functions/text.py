"""Text normalisation and small text functions as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters of Latin scripts and the base letter their canonical decomposition starts with."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


_FROM, _TO = _folding()


def folded(text: Column) -> Column:
    """Lower case without accents; the letters without a decomposition become their usual spelling."""
    text = F.translate(text, _FROM, _TO)
    text = F.regexp_replace(text, r"\p{M}+", "")
    for letter, plain in (("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def search_key(text: Column) -> Column:
    """Folded, without punctuation, with single spaces: what searches compare."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[!@$%^&*_=|~`<>?/\"]", ""), r"\s+", " "))


def search_text(*columns: Column) -> Column:
    return search_key(F.concat_ws(" ", *columns))


def truncated(text: Column, limit: int = 60) -> Column:
    """At most ``limit`` characters, cut after a whole word."""
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_extract(F.substring(text, 1, limit + 1), r"(?s)^(.*)\s", 1))


def clean_file_name(name: Column) -> Column:
    """Without extension and (nested) parentheses, single spaces."""
    name = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    for _ in range(4):
        name = F.regexp_replace(name, r"\s*\([^()]*\)", "")
    return F.trim(F.regexp_replace(name, r"[\s_]+", " "))


def token_counts_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' token counts, by array functions; 0 if either is empty."""

    def tokens(x):
        return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def count(words, w):
        return F.size(F.filter(words, lambda v: v == w))

    x, y = tokens(a), tokens(b)
    both = F.array_intersect(x, y)
    dot = F.aggregate(both, F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))

    def norm(words):
        return F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + count(words, w) * count(words, w)))

    size = norm(x) * norm(y)
    return F.coalesce(F.when(size > 0, dot / size), F.lit(0.0))


def names(values: Column) -> Column:
    """The distinct lower-cased names of an array."""
    return F.array_distinct(F.transform(values, F.lower))


def shared(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of names, lower-cased; 0 if either is empty."""
    return shared(names(a), names(b))


def _digits(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[^0-9Xx]", ""))


def _weighted(text: Column, weights: list[int]) -> Column:
    return sum((F.when(F.substring(text, i + 1, 1) == "X", 10).otherwise(F.substring(text, i + 1, 1).try_cast("int")) * w for i, w in enumerate(weights)), F.lit(0))


def isbn13(isbn10: Column) -> Column:
    """ISBN-10 -> ISBN-13 with a right check digit; other texts give null."""

    def made(text: Column) -> Column:
        body = F.concat(F.lit("978"), F.substring(text, 1, 9))
        check = lambda x: (10 - _weighted(x, [1, 3] * 6) % 10) % 10
        return F.when(text.rlike(r"^\d{9}[\dX]$"), let(body, lambda x: F.concat(x, check(x).cast("string"))))

    return let(_digits(isbn10), made)


def isbn10(isbn13_: Column) -> Column:
    """ISBN-13 that begins with 978 -> ISBN-10."""

    def made(text: Column) -> Column:
        figure = lambda check: F.when(check == 10, "X").otherwise(check.cast("string"))
        check = lambda x: (11 - _weighted(x, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11
        return F.when(text.rlike(r"^978\d{10}$"), let(F.substring(text, 4, 9), lambda x: F.concat(x, let(check(x), figure))))

    return let(_digits(isbn13_), made)


def valid_isbn(text: Column) -> Column:
    """Whether a text is an ISBN-10 or ISBN-13 with a right checksum."""

    def valid(x: Column) -> Column:
        ten = x.rlike(r"^\d{9}[\dX]$") & (_weighted(x, [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)
        thirteen = x.rlike(r"^\d{13}$") & (_weighted(x, [1, 3] * 6 + [1]) % 10 == 0)
        return F.coalesce(ten, F.lit(False)) | F.coalesce(thirteen, F.lit(False))

    return let(_digits(text), valid)


def file_type(name: Column) -> Column:
    """A file name's type: its extension, lower-cased, with synonyms folded."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin("cbr", "cbz", "cb7"), "cbx").when(extension == "azw", "azw3").when(extension != "", extension)
