"""File-name patterns, path templates, person names and hashed features as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: What a placeholder of a file-name pattern accepts.
_ACCEPTS = {"Year": r"(\d{4})", "SeriesNumber": r"(\d+(?:\.\d+)?)", "ISBN10": r"([\dXx]{10})", "ISBN13": r"(\d{13})", "*": r".*?"}


def pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """``{Title} - {Authors} ({Year})`` -> (regular expression for the whole name, placeholders in order)."""
    parts, names = [], []
    for text, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", pattern):
        parts.append(re.escape(text))
        if name:
            parts.append(_ACCEPTS.get(name, r"(.+?)"))
            if name != "*":
                names.append(name)
    return r"^\s*" + "".join(parts) + r"\s*$", names


def extracted(name: Column, pattern: str) -> Column:
    """A struct of the pattern's fields taken from a file name without extension; null where it doesn't match."""
    regex, names = pattern_regex(pattern)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    fields = [F.trim(F.regexp_extract(stem, regex, i + 1)).alias(n) for i, n in enumerate(names)]
    return F.when(stem.rlike(regex), F.struct(*fields))


_MODIFIERS = {
    "upper": F.upper,
    "lower": F.lower,
    "initial": lambda c: F.upper(F.substring(F.trim(c), 1, 1)),
    "first": lambda c: F.trim(F.element_at(F.split(c, ","), 1)),
    "sort": lambda c: F.regexp_replace(F.trim(F.element_at(F.split(c, ","), 1)), r"^(.*)\s+(\S+)$", "$2, $1"),
}


def path_template(template: str, fields: dict[str, Column]) -> Column:
    """``{authors}/<{series}/>{title}<|untitled>`` as a column: a part in <> appears if all its fields have values, else
    what follows its ``|``; ``{field:modifier}`` changes a value; characters that paths can't hold are dropped."""

    def value(token: str) -> Column:
        name, _, modifier = token.partition(":")
        column = fields.get(name, F.lit(None)).cast("string")
        clean = F.nullif(F.trim(F.regexp_replace(column, r'[\\/:*?"<>|\x00-\x1f]', "")), F.lit(""))
        return _MODIFIERS[modifier](clean) if modifier in _MODIFIERS else clean

    def text(part: str) -> tuple[list[Column], list[Column]]:
        pieces, used = [], []
        for plain, token in re.findall(r"([^{]*)(?:\{([^}]*)\})?", part):
            if plain:
                pieces.append(F.lit(plain))
            if token:
                used.append(value(token))
                pieces.append(F.coalesce(used[-1], F.lit("")))
        return pieces or [F.lit("")], used

    out = []
    for optional, plain in re.findall(r"<([^>]*)>|([^<]+)", template):
        if not optional:
            out += text(plain)[0]
            continue
        some, _, other = optional.partition("|")
        pieces, used = text(some)
        there = F.lit(True)
        for u in used:
            there = there & u.isNotNull()
        out.append(F.when(there if used else F.lit(False), F.concat(*pieces)).otherwise(F.concat(*text(other)[0])))
    return F.concat(*out)


def name_words(name: Column) -> Column:
    """A person's name as lower-cased words, given names first ("Last, First" is turned round)."""
    turned = F.regexp_replace(F.trim(name), r"^([^,]+),\s*(.+)$", "$2 $1")
    return F.filter(F.split(F.lower(turned), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def name_strength(a: Column, b: Column) -> Column:
    """How well two person names agree: 2 the same words, 1 the same last word and given names that agree by initials, else 0."""
    x, y = name_words(a), name_words(b)
    last = F.coalesce(F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)), F.lit(False))

    def given(w):
        return F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))

    pairs = F.filter(F.arrays_zip(given(x).alias("a"), given(y).alias("b")), lambda p: p.a.isNotNull() & p.b.isNotNull())
    short = lambda p, q: (F.length(p) == 1) & q.startswith(p)
    agree = F.forall(pairs, lambda p: (p.a == p.b) | short(p.a, p.b) | short(p.b, p.a))
    return F.when((F.size(x) > 0) & (x == y), 2).when(last & agree, 1).otherwise(0)


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (31) of a text's characters, as a signed integer."""
    low = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def hashed_features(words: Column, size: int = 128) -> Column:
    """Unit-length counts of words hashed to ``size`` places (an empty list gives zeros)."""
    places = F.transform(words, lambda w: F.pmod(F.abs(java_hash(w).cast("long")), F.lit(size)).cast("int"))

    def counted(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(length, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)).otherwise(counts))

    return let(let(places, counted), scaled)
