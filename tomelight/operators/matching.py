"""Files into books: grouping new files, matching them to books that have files in the folder or none yet, and claims.

Files are rows of (file, folder, name, author): folder is a key, author a person's name that the path gives or null. Nothing here
visits pairs within a folder: names meet by their identity, and what a label's files disagree in is a small set of values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import base_name, person, strength, title_identity
from ..functions.text import file_type
from .resolve import components, same_key_links, written
from .sets import spread

FILE = ["file", "folder", "name", "author"]


def identified(files: DataFrame) -> DataFrame:
    """files with identity, without_copy, copy, years and person of each name.

    Reading names is the work here and rows are short, so they are dealt evenly over all tasks first.
    """
    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *files.columns)
    x = spread.withColumns({"t": title_identity(base_name(F.col("name"))), "person": person(F.col("author"))})
    return x.select(*files.columns, "person", "t.*")


def grouped(files: DataFrame) -> DataFrame:
    """(file, group_key, members): files of one folder that are one book.

    Equal identities are one book. A copy mark is ignored where the folder has the file without it, else it reads as a number.
    Files that name different years are different books, and one that names none then belongs to neither; likewise files whose
    authors do not all agree. Files with one base name are always one book.
    """
    classes = written(files.groupBy(*FILE[1:]).agg(F.count("*").alias("n")))
    # reading is the work: each different name and author is read once, dealt evenly over all tasks
    once = lambda c: spread(classes.select(c).distinct(), c)
    names = once("name").select(F.col("name").alias("_name"), title_identity(base_name(F.col("name"))).alias("t"))
    persons = once("author").select(F.col("author").alias("_author"), person(F.col("author")).alias("person"))
    known = classes.join(names, F.col("name").eqNullSafe(F.col("_name"))).join(persons, F.col("author").eqNullSafe(F.col("_author")))
    return _placed(files, _keyed(written(known.select(*classes.columns, "person", "t.*"))))


def _disagreeing(labelled: DataFrame, most: int = 6) -> DataFrame:
    """(folder, label) of the labels whose persons don't all agree: another surname, no given name beside another person, or given
    names in one place that are neither equal nor each other's initials (places beyond ``most`` count as one)."""
    given = lambda i: F.get(F.col("person.given"), F.lit(i))
    rest = F.array_join(F.slice("person.given", most + 1, 99), " ")
    firsts = [F.substring(given(i), 1, 1) for i in range(most)]
    wholes = [F.when(F.length(given(i)) > 1, given(i)) for i in range(most)] + [F.when(rest != "", rest)]
    values = [F.col("person.surname"), *firsts, *wholes]
    sums = labelled.where("person is not null").groupBy("folder", "label").agg(
        F.min(F.to_json("person")).alias("p0"), F.max(F.to_json("person")).alias("p1"), F.min(F.size("person.given")).alias("fewest"), *(f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("a", F.min), ("b", F.max)))
    )
    differ = F.col("fewest") == 0
    for i in range(len(values)):
        differ = differ | F.coalesce(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(False))
    return sums.where((F.col("p0") != F.col("p1")) & differ).select("folder", "label")


def grouped_known(known: DataFrame) -> DataFrame:
    """(file, group_key, members) of files whose names are read: file, folder, name, author, person, identity, without_copy, copy, years."""
    says = [*FILE[1:], "person", "identity", "without_copy", "copy", "years"]
    return _placed(known, _keyed(written(known.groupBy(*says).agg(F.count("*").alias("n")))))


def _placed(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, group_key, members): the files with what ``_keyed`` says of their class."""
    theirs = keys.withColumnsRenamed({c: f"_{c}" for c in FILE[1:]})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FILE[1:]))
    return files.select(*FILE).join(theirs, same).select("file", "group_key", "members")


def _keyed(known: DataFrame) -> DataFrame:
    """(folder, name, author, group_key, members) of classes of n files that say the same; only here files meet, so rows are moved as classes."""
    plain = known.where("copy is null").select("folder", F.col("identity").alias("without_copy")).distinct().withColumn("there", F.lit(True))
    named = known.join(plain, ["folder", "without_copy"], "left")
    identity = F.when(F.col("copy").isNotNull() & F.col("there"), F.col("without_copy")).otherwise(F.col("identity"))
    base = F.lower(base_name(F.col("name")))
    # a name without a word left is only the same book as its own base name
    label = F.when(identity == "", F.concat(F.lit("="), base)).otherwise(identity)
    named = named.select(*FILE[1:], "n", "person", F.array_join("years", ",").alias("year"), label.alias("label"))
    years = named.groupBy("folder", "label").agg((F.count_distinct(F.when(F.col("year") != "", F.col("year"))) > 1).alias("split"))
    labelled = named.join(years, ["folder", "label"])
    of_year = F.when(F.col("year") != "", F.col("year")).otherwise(F.lit("no year"))
    labelled = labelled.withColumn("label", F.when(F.col("split"), F.concat("label", F.lit(" ("), of_year, F.lit(")"))).otherwise(F.col("label")))
    apart = _disagreeing(labelled).withColumn("apart", F.lit(True))
    labelled = labelled.join(apart, ["folder", "label"], "left")
    who = F.concat(F.lit(" by "), F.col("person.surname"), F.lit(" "), F.array_join("person.given", " "))
    labelled = labelled.withColumn("label", F.when(F.col("apart") & F.col("person").isNotNull(), F.concat("label", who)).otherwise(F.col("label")))
    labelled = labelled.select(*FILE[1:], "n", F.concat_ws(":", F.col("folder").cast("string"), "label").alias("group_key"))
    labelled = written(labelled)
    # labels that share a base name are one: few, so their links are
    names = labelled.select("folder", base.alias("base"), "group_key").distinct()
    links = written(same_key_links(names, F.concat_ws("/", F.col("folder").cast("string"), "base"), "group_key"))
    if not links.isEmpty():
        joined = components(links).withColumnsRenamed({"id": "group_key", "component": "one"})
        labelled = labelled.join(joined, "group_key", "left").select(*FILE[1:], "n", F.coalesce("one", "group_key").alias("group_key"))
    size = labelled.groupBy("group_key").agg(F.sum("n").alias("members"))
    return labelled.join(size, "group_key").select(*FILE[1:], "group_key", "members")


def _agreeing_years(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def in_folder(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, books, book): how many books of the file's folder have its title, and the least of them.

    new and existing: identified files; existing ones have a book. A copy mark folds into a book that is there.
    """
    held = existing.where("identity <> ''").select("folder", F.col("identity").alias("key"), F.col("years").alias("held_years"), "book").distinct()
    keys = F.explode(F.array_distinct(F.array("identity", "without_copy"))).alias("key")
    met = new.select("file", "folder", "years", keys).join(held, ["folder", "key"]).where(_agreeing_years(F.col("years"), F.col("held_years")))
    return met.groupBy("file").agg(F.count_distinct("book").alias("books"), F.min("book").alias("book"))


def fileless(new: DataFrame, shells: DataFrame) -> DataFrame:
    """(file, folder, name, rank, shells, shell): the books without files whose title agrees and whose author agrees best.

    shells: shell, identity, years, person. rank: 2 for a strong agreement of names, 1 for a weak one.
    """
    keyed = new.select("file", "folder", "name", F.col("years").alias("own"), F.col("person").alias("who"), F.col("without_copy").alias("identity"))
    # a name without a word is no title; names agree only with equal surnames
    persons = shells.where("identity <> ''").withColumn("surname", F.col("person.surname"))
    met = keyed.withColumn("surname", F.col("who.surname")).join(persons, ["identity", "surname"]).where(_agreeing_years(F.col("own"), F.col("years")))
    met = met.select("file", "folder", "name", "shell", strength(F.col("who"), F.col("person")).alias("rank")).where("rank > 0")
    best = met.groupBy("file").agg(F.max("rank").alias("rank"))
    return met.join(best, ["file", "rank"]).groupBy("file", "folder", "name", "rank").agg(F.count("*").alias("shells"), F.min("shell").alias("shell"))


def claims(found: DataFrame) -> DataFrame:
    """(file, shell, holds): whether a file's claim on its one fileless book holds.

    All claims on a book fail if they come from several folders, or if several files of one format make them; weak claims yield to
    strong ones.
    """
    one = found.where("shells = 1").withColumn("format", file_type(F.col("name")))
    formats = one.groupBy("shell", "rank", "format").agg(F.count("*").alias("n"))
    several = formats.groupBy("shell", "rank").agg((F.max("n") > 1).alias("twice"))
    strong = one.groupBy("shell").agg(F.max("rank").alias("strongest"))
    folders = one.join(strong, "shell").where("rank = strongest").groupBy("shell", "strongest").agg(F.count_distinct("folder").alias("folders"))
    judged = one.join(folders, "shell").join(several, ["shell", "rank"])
    return judged.select("file", "shell", ((F.col("rank") == F.col("strongest")) & (F.col("folders") == 1) & ~F.col("twice")).alias("holds"))


def decided(files: DataFrame, existing: DataFrame, shells: DataFrame) -> DataFrame:
    """(file, decision, target) of new files.

    existing: files with their book; shells: shell, name, author. attach-same-folder, attach-shell, ambiguous or new-book.
    """
    new = written(identified(files.select(*FILE)))
    here = written(in_folder(new, identified(existing.select(*FILE, "book"))))
    titled = identified(shells.select(F.col("shell"), "name", "author")).select("shell", F.col("without_copy").alias("identity"), "years", "person")
    open_ = new.join(here.select("file"), "file", "left_anti")
    found = written(fileless(open_, titled))
    held = claims(found)
    all_ = new.select("file").join(here, "file", "left").join(found.select("file", "shells"), "file", "left").join(held, "file", "left")
    decision = (
        F.when(F.col("books") == 1, "attach-same-folder").when(F.col("books") > 1, "ambiguous").when(F.col("holds"), "attach-shell").when(F.col("shells") > 0, "ambiguous").otherwise("new-book")
    )
    target = F.coalesce(F.when(F.col("books") == 1, F.col("book")).when(F.col("holds"), F.col("shell")).cast("string"), F.lit("-"))
    return all_.select("file", decision.alias("decision"), target.alias("target"))
