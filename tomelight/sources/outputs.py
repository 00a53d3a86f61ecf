"""Results for readers outside Spark: pages with totals, JSON rows, Atom feeds."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> dict:
    """One page (a bounded number of rows) with the totals around it."""
    total = rows.count()
    content = [r.asDict(recursive=True) for r in rows.orderBy(*order).offset(number * size).limit(size).collect()]
    pages = -(-total // size)
    return {"content": content, "number": number, "size": size, "totalElements": total, "totalPages": pages, "first": number == 0, "last": number >= pages - 1, "empty": not content}


def json_array(rows: DataFrame) -> Iterator[str]:
    """A JSON array piece by piece: one partition at a time reaches the driver."""
    yield "["
    for i, line in enumerate(rows.toJSON().toLocalIterator()):
        yield ("," if i else "") + line
    yield "]"


def atom_feed(title: str, link: str, found: dict) -> str:
    """An Atom feed of a page of rows (id, title, author, updated), with links to its neighbours."""
    parts = ['<?xml version="1.0" encoding="UTF-8"?>', '<feed xmlns="http://www.w3.org/2005/Atom">', f"<title>{escape(title)}</title>"]
    number = found["number"]
    for name, at, there in (("self", number, True), ("previous", number - 1, not found["first"]), ("next", number + 1, not found["last"])):
        if there:
            parts.append(f'<link rel="{name}" href="{escape(link)}?page={at}&amp;size={found["size"]}"/>')
    for row in found["content"]:
        parts.append(f"<entry><id>{escape(str(row['id']))}</id><title>{escape(str(row['title']))}</title><author><name>{escape(str(row.get('author') or ''))}</name></author><updated>{row.get('updated') or ''}</updated></entry>")
    return "".join([*parts, "</feed>"])
