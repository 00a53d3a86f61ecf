"""The catalogue's facets, sort orders and page pipeline over books with the usual columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .facets import Facet, filtered, natural_key, searched, surname_first

TOP = float("inf")
#: Bands of the facets (label, from, below). Some sizes are in no band.
RATING = [("0 to 1", 0, 1), ("1 to 2", 1, 2), ("2 to 3", 2, 3), ("3 to 4", 3, 4), ("4 to 4.5", 4, 4.5), ("4.5+", 4.5, TOP)]
FILE_SIZE = [("< 1 MB", 0, 1024), ("1–10 MB", 1024, 10240), ("10–50 MB", 10240, 51200), ("50–100 MB", 51200, 102400), ("250–500 MB", 256000, 512000), ("0.5–1 GB", 512000, 1048576), ("1–2 GB", 1048576, 2097152), ("5+ GB", 5242880, TOP)]
PAGE_COUNT = [("< 50 pages", 0, 50), ("50–100 pages", 50, 100), ("100–200 pages", 100, 200), ("200–400 pages", 200, 400), ("400–600 pages", 400, 600), ("600–1000 pages", 600, 1000), ("1000+ pages", 1000, TOP)]
MATCH_SCORE = [("Outstanding (95–100%)", 0.95, 1.01), ("Excellent (90–94%)", 0.9, 0.95), ("Great (80–89%)", 0.8, 0.9), ("Good (70–79%)", 0.7, 0.8), ("Fair (50–69%)", 0.5, 0.7), ("Weak (30–49%)", 0.3, 0.5), ("Poor (0–29%)", 0, 0.3)]
AGES = {0: "All Ages", 6: "6+", 10: "10+", 13: "13+", 16: "16+", 18: "18+", 21: "21+"}
STATUSES = ("UNREAD", "READING", "RE_READING", "PARTIALLY_READ", "PAUSED", "READ", "WONT_READ", "ABANDONED", "UNSET")
ROLES = ("penciller", "inker", "colorist", "letterer", "cover_artist", "editor")


def ranged(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    """The label of the band that holds a value: from its lower end up to below its upper end; else null."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(bands):
        out = F.when((value >= low) & (value < high) if high < TOP else value >= low, label).otherwise(out)
    return out


def _in_role(role: str):
    return lambda name: F.concat(name, F.lit(f":{role}"))


def book_facets() -> list[Facet]:
    """The 28 facets, over columns named as in ``SORTS`` and below."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    many = lambda name, c: Facet(name, F.col(c), True)
    status = F.when(F.col("read_status").isin(*STATUSES), F.col("read_status")).otherwise("UNSET")
    score = F.when(F.col("match_score") > 1, F.col("match_score") / 100).otherwise(F.col("match_score"))
    own = F.when((F.col("personal_rating") >= 1) & (F.col("personal_rating") <= 10) & (F.col("personal_rating") % 1 == 0), F.col("personal_rating").cast("int").cast("string"))
    age = F.coalesce(*[F.when(F.col("age_rating") == a, label) for a, label in AGES.items()])
    creators = F.concat(*[F.transform(F.coalesce(r, F.array().cast("array<string>")), _in_role(r)) for r in ROLES])
    return [
        many("author", "authors"), many("category", "categories"), Facet("series", F.nullif(F.trim("series_name"), F.lit(""))),
        Facet("bookType", F.when(F.col("physical"), "PHYSICAL").otherwise(text("book_type"))), Facet("readStatus", status), Facet("personalRating", own), Facet("publisher", text("publisher")),
        Facet("matchScore", ranged(score, MATCH_SCORE)), Facet("library", text("library")), many("shelf", "shelves"), Facet("shelfStatus", F.when(F.coalesce(F.size("shelves"), F.lit(0)) > 0, "shelved").otherwise("unshelved")),
        many("tag", "tags"), Facet("publishedDate", F.year("published").cast("string")), Facet("fileSize", ranged(F.col("file_size_kb"), FILE_SIZE)), Facet("amazonRating", ranged(F.col("amazon_rating"), RATING)),
        Facet("goodreadsRating", ranged(F.col("goodreads_rating"), RATING)), Facet("hardcoverRating", ranged(F.col("hardcover_rating"), RATING)), Facet("language", text("language")), Facet("pageCount", ranged(F.col("page_count"), PAGE_COUNT)),
        many("mood", "moods"), Facet("ageRating", age), Facet("contentRating", text("content_rating")), Facet("narrator", text("narrator")), many("comicCharacter", "characters"), many("comicTeam", "teams"),
        many("comicLocation", "locations"), Facet("comicCreator", creators, True), Facet("verificationStatus", text("verification")),
    ]


def _some(column: str) -> Column:
    """A number or text; 0 and the empty text count as none."""
    return F.when(F.col(column).cast("string") != "", F.nullif(F.col(column), F.lit(0))) if column in NUMBERS else F.nullif(F.col(column), F.lit(""))


NUMBERS = frozenset("page_count rating personal_rating review_count amazon_rating amazon_review_count goodreads_rating goodreads_review_count hardcover_rating hardcover_review_count ranobedb_rating file_size_kb".split())
PROGRESS = ("epub", "pdf", "cbx", "audiobook", "koreader", "kobo")


def sort_keys() -> dict[str, Column]:
    """The 28 sort fields as columns; texts by natural order, status by its rank."""
    joined = lambda c: F.nullif(F.array_join(F.transform("authors", c), ", "), F.lit(""))
    rank = F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("read_status")), F.lit(0))
    keys = {
        "title": natural_key(F.nullif(F.lower("title"), F.lit(""))), "author": natural_key(joined(F.lower)), "authorSurnameVorname": natural_key(joined(lambda a: F.lower(surname_first(F.trim(a))))),
        "publishedDate": F.col("published"), "publisher": natural_key(_some("publisher")), "pageCount": _some("page_count"), "rating": _some("rating"), "personalRating": _some("personal_rating"), "reviewCount": _some("review_count"),
        "amazonRating": _some("amazon_rating"), "amazonReviewCount": _some("amazon_review_count"), "goodreadsRating": _some("goodreads_rating"), "goodreadsReviewCount": _some("goodreads_review_count"), "hardcoverRating": _some("hardcover_rating"),
        "hardcoverReviewCount": _some("hardcover_review_count"), "ranobedbRating": _some("ranobedb_rating"), "locked": F.coalesce("locked", F.lit(False)), "lastReadTime": F.col("last_read"), "addedOn": F.col("added"),
        "fileSizeKb": _some("file_size_kb"), "fileName": natural_key(F.col("file_name")), "filePath": natural_key(F.col("file_path")), "random": F.md5(F.col("id").cast("string").cast("binary")), "seriesName": natural_key(F.nullif(F.lower("series_name"), F.lit(""))),
        "seriesNumber": F.col("series_number"), "readStatus": rank, "dateFinished": F.col("finished"), "readingProgress": F.coalesce(*[F.col(f"{p}_progress") for p in PROGRESS]),
    }
    return keys


def ordered(books: DataFrame, sorts: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns of (field, descending), nulls last when rising and first when falling; id decides."""
    keys = sort_keys()
    return [*(keys[n].desc_nulls_first() if falling else keys[n].asc_nulls_last() for n, falling in sorts), F.col("id").asc()]


def browse(books: DataFrame, words: str = "", active: dict[str, list[str]] | None = None, mode: str = "or", collapse: bool = False, sorts: list[tuple[str, bool]] = (), page: int = 0, size: int = 50) -> DataFrame:
    """A page of books: search, then facets, then one book a series (its lowest number), then the order.

    Adds ``members`` (books of the series if collapsed, else 1) and ``total`` (books before paging).
    """
    rows = searched(books, [F.col("title"), F.col("series_name"), F.array_join("authors", " ")], words)
    rows = filtered(rows, book_facets(), active or {}, mode).withColumn("members", F.lit(1).cast("long"))
    if collapse:
        series = F.nullif(F.trim("series_name"), F.lit(""))
        key = F.when(series.isNotNull(), F.concat(F.lit("s:"), series)).otherwise(F.concat(F.lit("b:"), F.col("id").cast("string")))
        first = rows.groupBy(key.alias("k")).agg(F.min(F.struct(F.col("series_number").isNull(), "series_number", "id")).alias("x"), F.count("*").alias("members"))
        rows = rows.drop("members").join(first.select(F.col("x.id").alias("id"), "members"), "id")
    total = rows.agg(F.count("*").alias("total"))  # one row
    paged = rows.orderBy(*ordered(rows, list(sorts))).offset(page * size).limit(size)
    return paged.join(F.broadcast(total))


def ranks(rows: DataFrame, orders: dict[str, list[Column]], first: int) -> DataFrame:
    """(sorted_by, place, id): the first rows in each of several orders; each order keeps ``first`` rows a task only."""
    out = None
    for name, order in orders.items():
        # the window sees ``first`` rows
        top = rows.orderBy(*order).limit(first).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        part = top.select(F.lit(name).alias("sorted_by"), "place", "id")
        out = part if out is None else out.union(part)
    return out
