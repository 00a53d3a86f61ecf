"""Title search through a token index on disk: a lookup reads the buckets of its tokens and no titles.

The index has one row for each distinct token of a title, with how many titles have the token, in folders by a hash of the token. A
lookup knows its tokens beforehand, so Spark prunes to their folders, and within them Parquet's filter on the token reads on. Titles are
ranked by the sum of their matched tokens' weights, ln(titles / titles with the token), so rare tokens decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_key


def tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(search_key(title), " "), lambda w: w != ""))


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(rows: DataFrame, path: str, key: str = "id", title: str = "title", keep: tuple[str, ...] = (), buckets: int = 64) -> None:
    """Write the index of rows under ``path``: token, df, all (titles in all), key and the columns ``keep``, by bucket."""
    posted = rows.select(key, *keep, F.explode(tokens(F.col(title))).alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("all"))  # one row
    placed = posted.join(counts, "token").join(F.broadcast(total)).withColumn("bucket", bucket_of(F.col("token"), buckets))
    # a bucket with a frequent token is dealt to several tasks by its keys, sorted by token so that filters skip row groups
    placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, words: str, order: list[Column], most: int = 10, key: str = "id", buckets: int = 64) -> DataFrame:
    """(key, matched, score): the best ``most`` titles for a text; equal scores by ``order``, then by key."""
    one = spark.range(1).select(tokens(F.lit(words)).alias("t")).select("t", F.transform("t", lambda x: bucket_of(x, buckets)).alias("b")).first()
    index = spark.read.parquet(path)
    hit = index.where(F.col("bucket").isin(one["b"] or [-1]) & F.col("token").isin(one["t"] or [""]))
    weight = F.log(F.col("all") / F.col("df"))
    others = [c for c in index.columns if c not in ("token", "df", "all", "bucket", key)]
    scored = hit.groupBy(key, *others).agg(F.sort_array(F.collect_list("token")).alias("matched"), F.round(F.sum(weight), 9).alias("score"))
    return scored.orderBy(F.desc("score"), *order, F.asc(key)).limit(most).select(key, "matched", "score")


def scanned(rows: DataFrame, words: str, order: list[Column], most: int = 10, key: str = "id", title: str = "title") -> DataFrame:
    """Where no token matches: titles that hold the text."""
    return rows.where(search_key(F.col(title)).contains(search_key(F.lit(words)))).orderBy(*order, F.asc(key)).limit(most).select(key)


def best_by_author(found: DataFrame, asked: DataFrame, key: str = "query") -> DataFrame:
    """(key, isbn13, isbn10, by) of each query with candidates: the edition that its title's search means.

    found: key, place, isbn13, isbn10, authors (candidates in order); asked: key, authors. Candidates without ISBN don't count. An only one is
    taken as it is, and where nobody is asked for, the first; else the first whose author agrees: one name holds the other, or
    they share a word, of three letters at least on the asked side. by: only, first, author or none.
    """
    plain = lambda names: F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(F.regexp_replace(F.lower(n), "[^a-z0-9 ]", ""))), lambda n: F.coalesce(n != "", F.lit(False)))
    words = lambda names: F.flatten(F.transform(names, lambda n: F.split(n, r"\s+")))
    usable = found.where("isbn13 is not null or isbn10 is not null").withColumn("theirs", plain(F.col("authors")))
    met = usable.join(asked.select(key, plain(F.col("authors")).alias("ours")), key)
    holds = F.exists("ours", lambda a: F.exists("theirs", lambda b: a.contains(b) | b.contains(a)))
    shares = F.arrays_overlap(F.filter(words(F.col("ours")), lambda w: F.length(w) >= 3), words(F.col("theirs")))
    edition = F.struct("place", "isbn13", "isbn10")
    one = met.groupBy(key).agg(F.count("*").alias("n"), F.min(edition).alias("first"), F.min(F.when(holds | shares, edition)).alias("agreed"), F.max(F.size("ours")).alias("asked"))
    by = F.when(F.col("n") == 1, "only").when(F.col("asked") == 0, "first").when(F.col("agreed").isNotNull(), "author").otherwise("none")
    chosen = F.when(by.isin("only", "first"), F.col("first")).otherwise(F.col("agreed"))
    return one.select(key, chosen.alias("x"), by.alias("by")).select(key, "x.isbn13", "x.isbn10", "by")


def plain_words(text: Column) -> Column:
    """Lower case, letters and figures only, single spaces; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))


def merged_results(results: DataFrame, asked: Column, query: str = "query") -> DataFrame:
    """One row a book that several providers found for a query: the columns of results, key, richness and relevance.

    results: query, place (the order in which they came), title, author (the first one), isbn13, description, thumbnail, year. Books are one by
    ISBN-13, else by title and first author; the richest row stays, the first of equals. relevance adds to the richness what the title has of
    the text that is asked for: 20 if equal, 12 if it begins with it, 6 if it holds it. Rows without title are left out.
    """
    title, wanted = plain_words(F.col("title")), plain_words(asked)
    isbn = F.nullif(F.trim("isbn13"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("isbn:"), isbn), F.concat(F.lit("ta:"), title, F.lit("|"), plain_words(F.col("author"))))
    points = [(F.col("thumbnail").isNotNull(), 3), (F.trim("description") != "", 2), (F.col("isbn13").isNotNull(), 2), (F.trim("author") != "", 2), (F.col("year").isNotNull(), 1)]
    rich = sum((F.when(F.coalesce(test, F.lit(False)), n).otherwise(0) for test, n in points), F.lit(0))
    fits = F.when(title == wanted, 20).when(title.startswith(wanted), 12).when(title.contains(wanted), 6).otherwise(0)
    told = results.where(F.trim("title") != "").withColumns({"key": key, "richness": rich, "relevance": rich + fits})
    every = F.struct(*told.columns)
    best = told.groupBy(query, "key").agg(F.max_by(every, F.struct("richness", -F.col("place"))).alias("x"))
    return best.select("x.*")


def release_score(title: Column, size: Column, seeders: Column, protocol: Column, wanted: Column, author: Column, formats: tuple[str, ...] = ("epub",), prefer_usenet: bool = False, most_mb: int = 500) -> Column:
    """How well a release fits a wanted book, 0 to 100: its title's words (45) and its author's (25; 12 if nobody is named), format by preference
    (15, 11, 7, 3), the preferred protocol (8), seeders (up to 7; none: -40; Usenet 4), too large (-50), a bundle (-30)."""
    normal = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    tokens = lambda c: F.array_distinct(F.filter(F.split(normal(c), r"\s+"), lambda t: F.length(t) > 2))
    name = normal(title)

    def overlap(text: Column, most: float) -> Column:
        found = tokens(text)
        hits = F.size(F.filter(found, lambda t: name.contains(t)))
        return F.when(F.size(found) > 0, F.floor(F.lit(most) * hits / F.size(found)).cast("int")).otherwise(0)

    kind = F.lit(0)
    for i, f in reversed(list(enumerate(formats))):
        kind = F.when(name.contains(f), max(15 - 4 * i, 3)).otherwise(kind)
    usenet = F.coalesce(F.lower(protocol) == "usenet", F.lit(False))
    health = F.when(usenet, 4).when(F.coalesce(seeders, F.lit(0)) == 0, -40).otherwise(F.least(seeders, F.lit(7)))
    bundle = name.rlike("collection|bundle|mega ?pack")
    named = F.coalesce(F.trim(author) != "", F.lit(False))
    total = F.coalesce(overlap(wanted, 45.0), F.lit(0)) + F.when(named, overlap(author, 25.0)).otherwise(12) + kind + F.when(usenet == F.lit(prefer_usenet), 8).otherwise(0) + health
    total = total - F.when(F.coalesce(size > most_mb * 1024 * 1024, F.lit(False)), 50).otherwise(0) - F.when(bundle, 30).otherwise(0)
    return F.when(title.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))


#: What each field adds to a book's completeness.
COMPLETENESS = {
    "title": 10, "subtitle": 1, "description": 10, "authors": 10, "publisher": 5, "published": 3, "series_name": 2, "series_number": 2, "series_total": 1, "isbn13": 3, "isbn10": 5, "language": 2, "page_count": 1,
    "categories": 10, "amazon_rating": 3, "amazon_review_count": 2, "goodreads_rating": 4, "goodreads_review_count": 2, "hardcover_rating": 2, "hardcover_review_count": 1, "douban_rating": 3, "douban_review_count": 2,
    "ranobedb_rating": 2, "cover": 5,
}


def completeness(rows: DataFrame, locks: dict[str, Column] | None = None, weights: dict[str, int] | None = None) -> Column:
    """Percent of the weights whose fields say something, or are locked: texts that aren't blank, lists with an element, numbers above 0, dates that are there.
    A field that rows lack says nothing, but its weight counts."""
    weights, locks, kinds = weights or COMPLETENESS, locks or {}, dict(rows.dtypes)
    total, score = sum(weights.values()), F.lit(0)
    for field, weight in weights.items():
        kind, column = kinds.get(field), F.col(field)
        there = F.lit(False)
        if kind is not None and kind.startswith("array"):
            there = F.size(column) > 0
        elif kind == "string":
            there = F.regexp_replace(column, r"\s", "") != ""
        elif kind in ("date", "timestamp", "boolean"):
            there = column.isNotNull()
        elif kind is not None:
            there = column > 0
        locked = locks.get(field, F.lit(False))
        score = score + F.when(F.coalesce(there, F.lit(False)) | F.coalesce(locked, F.lit(False)), weight).otherwise(0)
    return score / total * 100 if total else F.lit(0.0)
