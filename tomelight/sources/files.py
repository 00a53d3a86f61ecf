"""Files as tables: listings, book formats, sidecar JSON, tab-separated exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_type

METADATA = "path string, format string, title string, authors array<string>, language string, publisher string, series string, number string, identifiers array<string>, pages int, error string"


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modified, type of every file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), file_type(F.col("path")).alias("type"))


def missing_files(stored: DataFrame, folder: str) -> DataFrame:
    """Stored paths that the folder no longer holds; an empty listing while rows are stored is an error, not a purge."""
    spark = stored.sparkSession
    there = listing(spark, folder).select("path")
    if there.isEmpty() and not stored.isEmpty():
        raise RuntimeError("the listing is empty but files are stored")
    return stored.join(there, "path", "left_anti")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _package(content: bytes) -> dict:
    """Metadata of an EPUB's package document."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(book.read(root))
        pages = sum(_local(e.tag) == "itemref" for e in package.iter())
    out: dict = {"authors": [], "identifiers": [], "pages": pages}
    for e in package.iter():
        name, text = _local(e.tag), (e.text or "").strip()
        if name == "creator" and text:
            out["authors"].append(text)
        elif name == "identifier" and text:
            out["identifiers"].append(text)
        elif name in ("title", "language", "publisher") and text:
            out.setdefault(name, text)
        elif name == "meta" and e.get("name") == "calibre:series":
            out["series"] = e.get("content")
        elif name == "meta" and e.get("name") == "calibre:series_index":
            out["number"] = e.get("content")
    return out


def _comic(content: bytes) -> dict:
    """Metadata of a zipped comic: ComicInfo.xml and the number of images."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        pages = sum(n.lower().endswith((".jpg", ".jpeg", ".png", ".webp", ".gif")) for n in names)
        info = next((n for n in names if n.rpartition("/")[2].lower() == "comicinfo.xml"), None)
        found = {_local(e.tag): (e.text or "").strip() for e in ElementTree.fromstring(book.read(info))} if info else {}
    authors = [a.strip() for k in ("Writer", "Penciller") for a in found.get(k, "").split(",") if a.strip()]
    return {"title": found.get("Title"), "authors": list(dict.fromkeys(authors)), "language": found.get("LanguageISO"), "publisher": found.get("Publisher"), "series": found.get("Series"), "number": found.get("Number"), "identifiers": [], "pages": pages}


def _fiction(content: bytes) -> dict:
    """Metadata of an FB2 file."""
    root = ElementTree.fromstring(content)
    info = next((e for e in root.iter() if _local(e.tag) == "title-info"), root)
    out: dict = {"authors": [], "identifiers": []}
    for e in info:
        name = _local(e.tag)
        if name == "author":
            out["authors"].append(" ".join((c.text or "").strip() for c in e if _local(c.tag) in ("first-name", "middle-name", "last-name")).strip())
        elif name == "book-title":
            out["title"] = (e.text or "").strip()
        elif name == "lang":
            out["language"] = (e.text or "").strip()
        elif name == "sequence":
            out["series"], out["number"] = e.get("name"), e.get("number")
    return out


_READERS = {"epub": _package, "cbx": _comic, "fb2": _fiction}


def book_metadata(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row a book file: metadata read from its own format, or an error; a broken file never fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    typed = files.select("path", file_type(F.col("path")).alias("format"), "content").where(F.col("format").isin(*_READERS))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in METADATA.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    found = _READERS[r.format](bytes(r.content))
                    rows.append({"path": r.path, "format": r.format, "error": None, **found})
                except Exception as error:  # a file can be broken in any way; its row says how
                    rows.append({"path": r.path, "format": r.format, "authors": [], "identifiers": [], "error": f"{type(error).__name__}: {error}"})
            frame = pd.DataFrame(rows, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    return typed.mapInPandas(read, METADATA)


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Sidecar JSON documents (one a file) with their path."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.input_file_name())


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exports with NULL for null and backslash escapes for tab, line end and backslash."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("nullValue", "NULL").option("quote", "").option("escape", "").csv(path)
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]

    def plain(c):
        parts = F.split(c, r"\\\\", -1)
        return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))), "\\")

    return rows.withColumns({c: plain(F.col(c)) for c in texts})
