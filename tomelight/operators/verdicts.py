"""Which book each new file of a rescan belongs to, in three levels: the file's own verdict, its group's, and the claims on a book.

1. A file is compared with the books that have files in its folder, else with the books that have no file yet (shells). Its
   match is strong, or weak: one of several alike shells, or a name whose " (1)" is read as a copy's.
2. Files that would be one new book are a group. It goes to the one book of its best matches; the others follow. It becomes a new
   book if its best matches differ, or if one of its files says that it is not the book (another author, year, number or path).
3. Files claim their shell. It gets them if they come from one folder and no two names of one format differ; else its strong claims
   alone if these agree; else none.

Modes: AUTO_DETECT (as above), BOOK_PER_FOLDER (a folder is a book; an audiobook without one belongs to the ebook in the nearest
folder above) and BOOK_PER_FILE (each file is a book, only shells are looked at).

files: file, path, folder, name, author (whom the path names, or null); existing ones also book; shells: shell, path, name, author,
physical, number (place in a series). A folder is its path below the library path, "" the root, with "/" between its parts.

Scale: names meet by equal keys and are reduced to classes first (files that say the same, books that say the same), so a hot title
meets as many rows as it has authors and years, and author joins carry the surname. Whether a file turns its group's book down is looked
up for that one book. Everything is a grouping with map-side combine or an equi-join; no group of rows is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import base_name, person, strength, title_identity
from ..functions.text import file_type
from .matching import grouped_known
from .resolve import written
from .sets import spread

MODES = ("AUTO_DETECT", "BOOK_PER_FOLDER", "BOOK_PER_FILE")
AUDIO = ("m4b", "m4a", "mp3", "opus")
_COPY_WORD = r"(?i)(\s+[-–—]\s*copy(\s*\(?\d{1,2}\)?)?|\s*\(\s*copy(\s*\d{1,2})?\s*\))$"
_COPY_NUMBER = r"\s*\(([1-9])\)$"
_AUDIO_PART = r"(?i)(\s*[\(\[](part|pt|disc|disk|cd)\s*\d{1,4}(\s*of\s*\d{1,4})?[\)\]]|\s*[\(\[]\d{1,2}\s*(of|-|/)\s*\d{1,2}[\)\]]|(\s*[-–—]\s*|\s)(part|pt|disc|disk|cd)\s*\d{1,4}(\s*of\s*\d{1,4})?)$"


def read_names(files: DataFrame) -> DataFrame:
    """files with what their names say: base, format, identity (as a title; a bare copy has its original's), plain (without a copy
    mark), mark (a copy's number, 0 for " - Copy"), years, who (the person of author), and copies (the name that copies and parts share)."""
    base = base_name(F.col("name"))
    # reading is the work: each different name and author is read once, dealt evenly over all tasks
    once = lambda c: spread(files.select(c), c).distinct()
    read = once("name").select(F.col("name").alias("_name"), title_identity(base, file_type(F.col("name")) == "cbx").alias("t"), F.lower(base).alias("base"), file_type(F.col("name")).alias("format"))
    persons = once("author").select(F.col("author").alias("_author"), person(F.col("author")).alias("who"))
    word = F.col("base").rlike(_COPY_WORD)
    mark = F.when(F.col("t.copy").isNotNull(), F.when(word, 0).otherwise(F.col("t.copy")))
    copies = F.regexp_replace(F.when(word, F.regexp_replace("base", _COPY_WORD, "")).otherwise(F.regexp_replace("base", _COPY_NUMBER, "")), r"\s+", " ")
    copies = F.trim(F.when(F.col("format").isin(*AUDIO), F.regexp_replace(copies, _AUDIO_PART, "")).otherwise(copies))
    identity = F.when(mark == 0, F.col("t.without_copy")).otherwise(F.col("t.identity"))
    own = {"identity": identity, "plain": F.col("t.without_copy"), "mark": mark, "years": F.array_join("t.years", ","), "copies": copies}
    titled = F.struct(F.col("t.identity").alias("identity"), F.col("t.copy").alias("copy"), F.col("t.years").alias("years"), F.col("t.without_copy").alias("without_copy"))
    names = read.withColumns(own).withColumn("titled", titled).drop("t")
    known = files.join(names, F.col("name").eqNullSafe(F.col("_name"))).join(persons, F.col("author").eqNullSafe(F.col("_author")))
    return known.select(*files.columns, "base", "who", "format", *own, "titled")


def folder_key() -> Column:
    return F.concat_ws(":", "path", "folder")


def ancestors(folder: Column) -> Column:
    """The folders above a folder, nearest first; the root is none of them."""
    parts = F.split(folder, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def nearest_above(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """rows with the columns of the nearest folder above theirs that folders(path, above, ...) holds; rows without one are left out."""
    names = [c for c in folders.columns if c not in ("path", "above")]
    spread = rows.select("*", F.posexplode(ancestors(F.col("folder"))).alias("steps", "above"))
    hit = spread.join(folders, ["path", "above"])
    best = hit.groupBy(*rows.columns).agg(F.min_by(F.struct("above", *names), "steps").alias("hit"))
    return best.select(*rows.columns, "hit.*")


def groups(known: DataFrame, mode: str) -> DataFrame:
    """(file, group_key): the new book that each file would be part of."""
    alone = F.concat_ws(":", "path", "folder", "name")
    if mode == "BOOK_PER_FILE":
        return known.select("file", alone.alias("group_key"))
    if mode == "AUTO_DETECT":
        return grouped_known(known.select("file", folder_key().alias("folder"), "name", "author", F.col("who").alias("person"), "titled.*")).select("file", "group_key")
    audio = F.col("format").isin(*AUDIO)
    rooted = known.select("file", "path", "folder", "name", F.coalesce(audio, F.lit(False)).alias("audio"))
    ebooks = rooted.where("not audio").select("path", F.col("folder").alias("above")).distinct()
    deep = nearest_above(rooted.where("audio and folder <> ''").select("file", "path", "folder"), ebooks).select("file", "above")
    found = rooted.join(deep, "file", "left")
    key = F.when(F.col("folder") == "", F.concat_ws("::", "path", "name")).otherwise(F.concat_ws(":", "path", F.coalesce("above", "folder")))
    return found.select("file", key.alias("group_key"))


def _entry_keys() -> Column:
    """What a file of a book can be found by: its base name, its title, its title if it is no copy, and its original's title if it is one."""
    named, marked = F.col("identity") != "", F.col("mark").isNotNull()
    parts = [F.concat(F.lit("b"), "base"), F.when(named, F.concat(F.lit("i"), "identity")), F.when(named & ~marked, F.concat(F.lit("w"), "identity")), F.when(marked & (F.col("plain") != ""), F.concat(F.lit("c"), "plain"))]
    return F.array_compact(F.array(*parts))


def _entries(existing: DataFrame) -> DataFrame:
    """(key, folder_key, least, most, years, who): the books of a folder by what their files' names say. Keys begin with what they are."""
    rows = existing.select(folder_key().alias("folder_key"), F.explode(_entry_keys()).alias("key"), "book", "years", "who")
    base = F.col("key").startswith("b")
    rows = rows.withColumns({"years": F.when(base, "").otherwise(F.col("years")), "who": F.when(~base, F.col("who"))})
    return rows.groupBy("folder_key", "key", "years", "who").agg(F.min("book").alias("least"), F.max("book").alias("most"))


def _reading_keys() -> Column:
    """What of a folder's entries a file's name reads as."""
    named = F.col("identity") != ""
    originals = F.when(F.col("mark").isNotNull() & (F.col("plain") != ""), F.concat(F.lit("w"), "plain"))
    copies = F.when(F.col("mark").isNull() & named, F.concat(F.lit("c"), "identity"))
    return F.array_compact(F.array(F.concat(F.lit("b"), "base"), F.when(named, F.concat(F.lit("i"), "identity")), originals, copies))


def _accepts(own_years: Column, own: Column, years: Column, who: Column) -> Column:
    """Whether nothing speaks against an entry of equal title: years that differ, or persons that don't agree at all."""
    years_agree = (own_years == "") | (years == "") | (own_years == years)
    apart = own.isNotNull() & (F.size(own["given"]) > 0) & who.isNotNull() & (strength(own, who) == 0)
    return years_agree & ~F.coalesce(apart, F.lit(False))


def in_folder(known: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, here, here_reason, here_open): the one book of the folder that the name reads as; here_open: whether shells may be looked at."""
    entries = _entries(existing)
    says = ["folder_key", "base", "identity", "plain", "mark", "years", "who"]
    rows = known.withColumn("folder_key", folder_key())
    classes = rows.select(*says).distinct().withColumn("class", F.struct(*says)).withColumn("key", F.explode(_reading_keys()))
    theirs = entries.select("folder_key", "key", F.col("years").alias("held"), F.col("who").alias("holder"), "least", "most")
    met = classes.join(theirs, ["folder_key", "key"])
    accepted = F.col("key").startswith("b") | _accepts(F.col("years"), F.col("who"), F.col("held"), F.col("holder"))
    judged = met.withColumn("ok", accepted).groupBy("class").agg(F.min(F.when(F.col("ok"), F.col("least"))).alias("least"), F.max(F.when(F.col("ok"), F.col("most"))).alias("most"))
    one = F.col("least") == F.col("most")
    reason = F.when(one, "folder: same title in the same folder").when(F.col("least").isNotNull(), "folder: several books in the folder have this title").otherwise("folder: the books with this title are another author's or year's")
    judged = judged.select("class.*", F.when(one, F.col("least")).alias("here"), reason.alias("here_reason"), F.col("least").isNull().alias("here_open"))
    condition = [rows[c].eqNullSafe(judged[c]) for c in says]
    same = condition[0]
    for c in condition[1:]:
        same = same & c
    return rows.join(judged, same).select("file", "here", "here_reason", "here_open")


def book_of_folder(known: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, here, here_reason, here_open) in BOOK_PER_FOLDER: the book of the file's folder, or for an audiobook that of the ebook in the nearest folder above."""
    held = existing.where("folder <> ''")
    books = held.groupBy("path", "folder").agg(F.min("book").alias("least"), F.max("book").alias("most"))
    ebooks = held.where(~F.coalesce(F.col("format").isin(*AUDIO), F.lit(False))).groupBy("path", F.col("folder").alias("above")).agg(F.min("book").alias("least"), F.max("book").alias("most"))
    rows = known.where("folder <> ''").select("file", "path", "folder", "format")
    own = rows.join(books, ["path", "folder"])
    lost = rows.where(F.col("format").isin(*AUDIO)).join(books, ["path", "folder"], "left_anti").select("file", "path", "folder")
    above = nearest_above(lost, ebooks)
    one = F.col("least") == F.col("most")
    found = own.select("file", "least", "most", F.lit("its folder").alias("where")).unionByName(above.select("file", "least", "most", F.lit("the nearest folder above with an ebook").alias("where")))
    reason = F.concat(F.when(one, F.lit("folder: the book of ")).otherwise(F.lit("folder: several books have files in ")), F.col("where"))
    return found.select("file", F.when(one, F.col("least")).alias("here"), reason.alias("here_reason"), F.lit(False).alias("here_open"))


def read_shells(shells: DataFrame) -> DataFrame:
    """shells with identity, years and who."""
    read = shells.withColumns({"t": title_identity(F.col("name")), "who": person(F.col("author"))})
    return read.select("shell", F.col("path").alias("shell_path"), "physical", "number", F.col("t.without_copy").alias("title"), F.array_join("t.years", ",").alias("shell_years"), F.col("who").alias("writer"))


def _against(path: Column, who: Column) -> tuple[Column, Column]:
    """(why the shell is not the file's book although its title is, whether that is evidence against it and not only a want of it)."""
    writer, given = F.col("writer"), F.coalesce(F.size(who["given"]) > 0, F.lit(False))
    agree = F.coalesce(strength(who, writer) == 2, F.lit(False))
    one_word = ~F.col("title").contains(" ")
    alike = F.coalesce(F.get(who["given"], F.lit(0)) == F.get(writer["given"], F.lit(0)), F.lit(False))
    elsewhere = F.col("shell_path").isNotNull() & (F.col("shell_path") != path)
    why = (
        F.when(elsewhere, "is in another library path")
        .when(writer.isNull() & ~F.col("physical"), "has no author to check the file against")
        .when(writer.isNull(), None)
        .when(given & ~agree, "is not by the file's author")
        .when(~agree, "has none of its authors in the path")
        .when(one_word & ~alike, "has a one-word title, which needs its author's given name in the path")
    )
    return why, elsewhere | F.coalesce(writer.isNotNull() & given & ~agree, F.lit(False))


def _readings() -> Column:
    """The titles that a name reads as: itself, and without a " (1)" that is no comic's issue."""
    copy = (F.col("mark") == 1) & ~F.coalesce(F.col("format") == "cbx", F.lit(False)) & (F.col("plain") != "") & (F.col("plain") != F.col("identity"))
    own = F.when(F.col("identity") != "", F.struct(F.col("identity").alias("title"), F.lit(False).alias("as_copy")))
    return F.array_compact(F.array(own, F.when(copy, F.struct(F.col("plain").alias("title"), F.lit(True).alias("as_copy")))))


def among_shells(known: DataFrame, shells: DataFrame) -> DataFrame:
    """(file, shell, shell_rank, shell_reason) of files whose name reads as some shell's title; shell is null where none or several qualify.

    shells: as ``read_shells`` gives them. Shells that say the same are one class: its count, and the one that a file would get (not physical, then least).
    """
    says = ["path", "identity", "plain", "mark", "format", "who"]
    classes = known.select(*says).distinct().withColumn("class", F.struct(*says)).withColumn("r", F.explode(_readings())).select("class", "path", "who", "r.*")
    first = F.min(F.struct("physical", "shell")).alias("first")
    alike = shells.groupBy("title", "shell_years", "number", "writer", "shell_path", "physical").agg(first, F.count("*").alias("n"))
    surname = F.coalesce(F.col("writer.surname"), F.lit("?"))
    alike = alike.withColumn("surname", surname)
    # a shell with an author can only be the book of a file that names the surname; others are met by their title alone
    wanted = classes.withColumn("surname", F.explode(F.array_distinct(F.array(F.coalesce(F.col("who.surname"), F.lit("?")), F.lit("?")))))
    met = wanted.join(alike, ["title", "surname"])
    why, _ = _against(F.col("path"), F.col("who"))
    met = met.where(why.isNull())
    # " (1)" may be volume 1: a book that says it is another volume is doubted
    doubted = F.col("as_copy") & F.coalesce(F.col("number") != 1, F.lit(False)) & ~F.col("title").rlike(r"\d")
    kind = F.when(~F.col("as_copy"), "strong").when(doubted, "doubted").otherwise("copy")
    told = F.to_json(F.struct("shell_years", F.coalesce(F.col("number").cast("string"), F.lit("-")).alias("number"), F.coalesce(F.to_json("writer"), F.lit("-")).alias("writer"), "title"))
    found = met.select("class", kind.alias("kind"), "first", "n", told.alias("told"), F.col("writer").isNull().alias("nameless"))
    sums = found.groupBy("class", "kind").agg(F.min("first").alias("first"), F.sum("n").alias("n"), (F.min("told") == F.max("told")).alias("same"), F.max("nameless").alias("nameless"))
    by_kind = lambda name, column: F.max(F.when(F.col("kind") == name, F.col(column)))
    flat = sums.groupBy("class").agg(*(by_kind(k, c).alias(f"{k}_{c}") for k in ("strong", "copy", "doubted") for c in ("first", "n", "same", "nameless")))
    titles = shells.select("title").distinct()
    reads = classes.join(titles, "title", "left_semi").select("class").distinct()
    flat = flat.withColumnRenamed("class", "of")
    all_ = reads.join(flat, F.col("class").eqNullSafe(F.col("of")), "left").drop("of")
    chosen = lambda k: (F.col(f"{k}_n") == 1) | F.col(f"{k}_same") & ~F.col(f"{k}_nameless")
    several = lambda k: F.concat(F.lit("fileless: title and author agree, one of "), F.col(f"{k}_n").cast("string"), F.lit(" alike books"))
    strong, copy = F.col("strong_n") > 0, F.col("copy_n") > 0
    shell = F.when(strong, F.when(chosen("strong"), F.col("strong_first.shell"))).when(copy & F.col("doubted_n").isNull(), F.when(chosen("copy"), F.col("copy_first.shell")))
    rank = F.when(strong & (F.col("strong_n") == 1), 2).when(strong | copy, 1)
    reason = (
        F.when(strong & (F.col("strong_n") == 1), "fileless: title and author agree")
        .when(strong & chosen("strong"), several("strong"))
        .when(strong | copy & (F.col("doubted_n").isNotNull() | ~chosen("copy")), "fileless: several books qualify")
        .when(copy & (F.col("copy_n") == 1), 'fileless: title and author agree (" (1)" read as a copy)')
        .when(copy, F.concat(several("copy"), F.lit(' (" (1)" read as a copy)')))
        .when(F.col("doubted_n") > 0, 'fileless: is another volume, and " (1)" may mean volume 1')
        .otherwise("fileless: no book with this title has the file's author")
    )
    judged = all_.select("class.*", shell.alias("shell"), F.when(shell.isNotNull(), rank).alias("shell_rank"), reason.alias("shell_reason"), F.coalesce(strong, F.lit(False)).alias("shell_named"))
    same = judged["path"].eqNullSafe(known["path"])
    for c in says[1:]:
        same = same & judged[c].eqNullSafe(known[c])
    return known.join(judged, same).select("file", "shell", "shell_rank", "shell_reason", "shell_named")


def _refusing(members: DataFrame, existing: DataFrame, shells: DataFrame, auto: bool) -> DataFrame:
    """(group_key): groups of which a file says that it is not the group's book.

    members: the files with known columns, group_key, top and target of their group, kind of the target, and their own match.
    """
    open_ = members.where(F.coalesce(F.col("own_rank"), F.lit(0)) < 2)
    found = open_.select("group_key").limit(0)
    if auto:
        # of a folder's book: all its entries that the name reads as are another author's or year's
        here = open_.where("kind = 'folder' and here_open").withColumn("folder_key", folder_key()).withColumn("key", F.explode(_reading_keys()))
        entries = existing.select(folder_key().alias("folder_key"), F.col("book").alias("target"), F.explode(_entry_keys()).alias("key"), F.col("years").alias("held"), F.col("who").alias("holder")).distinct()
        met = here.join(entries, ["folder_key", "target", "key"])
        ok = F.col("key").startswith("b") | _accepts(F.col("years"), F.col("who"), F.col("held"), F.col("holder"))
        turned = met.groupBy("file", "group_key").agg(F.max(ok).alias("ok")).where("not ok")
        found = turned.select("group_key")
    # of a shell: a reading finds it by title and something speaks against it
    outer = open_.where("kind = 'shell'").withColumn("r", F.explode(_readings())).select("file", "group_key", "top", "target", "path", "who", "own_rank", "shell_named", "r.*")
    theirs = shells.withColumn("target", F.col("shell"))
    met = outer.join(theirs, ["target", "title"])
    why, against = _against(F.col("path"), F.col("who"))
    # what only a copy reading says, or a name that reads as several books, counts only against a book that weak matches give
    counts = against & ((F.col("top") < 2) | ~F.col("as_copy") & ~F.coalesce(F.col("shell_named"), F.lit(False)))
    turned = met.where(why.isNotNull()).where(counts)
    return found.union(turned.select("group_key")).distinct()


def resolved_claims(claims: DataFrame) -> DataFrame:
    """claims(shell, folder, format, copies, strong) -> (shell, verdict): all, strong or none, with why they don't all agree."""
    strong = lambda c: F.when(F.col("strong"), F.col(c))
    parts = claims.groupBy("shell", "format").agg(
        *(f(c).alias(f"{n}_{c}") for c in ("copies", "folder") for n, f in (("min", F.min), ("max", F.max))),
        *(f(strong(c)).alias(f"{n}_strong_{c}") for c in ("copies", "folder") for n, f in (("min", F.min), ("max", F.max))),
    )
    per = lambda pre: [F.max(F.col(f"min_{pre}copies") != F.col(f"max_{pre}copies")).alias(f"{pre}names"), (F.min(f"min_{pre}folder") != F.max(f"max_{pre}folder")).alias(f"{pre}folders")]
    books = parts.groupBy("shell").agg(*per(""), *per("strong_"))
    split = F.col("names") | F.col("folders")
    alone = ~F.col("strong_names") & ~F.col("strong_folders")
    why = F.when(F.col("folders"), "claimed by files of several folders").when(F.col("names"), "claimed by different files of one format")
    return books.select("shell", F.when(~split, "all").when(F.coalesce(alone, F.lit(False)), "strong").otherwise("none").alias("verdict"), why.alias("why"))


def rescanned(files: DataFrame, existing: DataFrame, shells: DataFrame, mode: str = "AUTO_DETECT") -> DataFrame:
    """One row a new file: file, decision, target, group_key, reason, weak_match.

    decision: attach-same-folder, attach-shell, ambiguous or new-book; target: the book's id or "-". weak_match: what came of a weak
    match: attached, agrees (with its group's strong match), yielded, lost, or "-" where none had a part.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    columns = ["file", "path", "folder", "name", "author"]
    # names are read once for all three tables
    every = files.select(F.lit("n").alias("role"), *columns, F.lit(None).cast("long").alias("book")).unionByName(existing.select(F.lit("e").alias("role"), *columns, F.col("book").cast("long").alias("book")))
    every = every.withColumns({c: F.coalesce(c, F.lit("")) for c in ("folder", "name")})  # a missing name is one without words
    read = written(read_names(every))
    known, old = read.where("role = 'n'").drop("role", "book"), read.where("role = 'e'").drop("role")
    titled = written(read_shells(shells))
    grouped = groups(known, mode)
    own = known.join(grouped, "file")
    if mode == "BOOK_PER_FILE":
        own = own.withColumns({"here": F.lit(None).cast("long"), "here_reason": F.lit(None).cast("string"), "here_open": F.lit(True)})
    else:
        here = in_folder(known, old) if mode == "AUTO_DETECT" else book_of_folder(known, old)
        own = own.join(here, "file", "left")
    looking = F.col("here").isNull() & F.coalesce(F.col("here_open"), F.lit(True))
    own = own.join(among_shells(known, titled), "file", "left")
    # shell_named stays: what a name reads as counts for its group's book, whatever the folder says
    own = own.withColumns({c: F.when(looking, F.col(c)) for c in ("shell", "shell_rank", "shell_reason")}).withColumn("here_open", F.coalesce("here_open", F.lit(True)))
    own = own.withColumns({
        "own": F.coalesce("here", "shell"),
        "own_kind": F.when(F.col("here").isNotNull(), "folder").when(F.col("shell").isNotNull(), "shell"),
        "own_rank": F.when(F.col("here").isNotNull(), 2).otherwise(F.col("shell_rank")),
    })
    own = written(own)

    # groups
    tops = own.groupBy("group_key").agg(F.max("own_rank").alias("top"))
    best = own.join(tops, "group_key").where("own_rank = top").groupBy("group_key", "top")
    picked = F.struct("own", "own_kind")
    best = best.agg(F.min(picked).alias("least"), F.max(picked).alias("most"), F.min_by(folder_key(), "file").alias("claim_folder"))
    best = best.select("group_key", "top", "claim_folder", F.col("least.own").alias("target"), F.col("least.own_kind").alias("kind"), (F.col("least") != F.col("most")).alias("split"))
    members = own.join(best.where("not split"), "group_key")
    refused = _refusing(members, old, titled, mode == "AUTO_DETECT").withColumn("refused", F.lit(True))
    verdicts = best.join(refused, "group_key", "left")
    gone = F.col("split") | F.col("refused").isNotNull()
    judged = own.join(verdicts, "group_key", "left")
    follows = F.coalesce((F.col("own") != F.col("target")) | F.col("own").isNull() | (F.col("own_rank") < F.col("top")), F.lit(False))
    judged = judged.withColumns({
        "follows": follows & ~F.coalesce(gone, F.lit(True)),
        "final": F.when(~F.coalesce(gone, F.lit(True)), F.col("target")),
        "why_group": F.when(F.col("split"), "group: its files match different books").when(F.col("refused"), "group: a file of it is not its book"),
        "claim": F.when(follows, F.col("claim_folder")).otherwise(folder_key()),
    })
    judged = written(judged)

    # claims
    one_file = mode == "BOOK_PER_FILE"
    format_, copies = (F.lit("file"), F.concat_ws("/", folder_key(), "name")) if one_file else (F.coalesce("format", F.lit("?")), F.col("copies"))
    claims = judged.where("final is not null and kind = 'shell'").select(F.col("final").alias("shell"), F.col("claim").alias("folder"), format_.alias("format"), copies.alias("copies"), (F.col("top") == 2).alias("strong"))
    resolved = resolved_claims(claims).withColumnsRenamed({"shell": "final"}).withColumn("kind", F.lit("shell"))
    out = judged.join(resolved, ["final", "kind"], "left")
    kept = F.coalesce((F.col("verdict") == "all") | (F.col("verdict") == "strong") & (F.col("top") == 2) | (F.col("kind") == "folder"), F.lit(False)) & F.col("final").isNotNull()
    several = F.coalesce(F.col("here_reason"), F.lit("")).contains("several") | F.coalesce(F.col("shell_reason"), F.lit("")).contains("several")
    claimed = F.col("final").isNotNull() & ~kept
    decision = F.when(kept & (F.col("kind") == "folder"), "attach-same-folder").when(kept, "attach-shell").when(claimed | F.col("why_group").isNotNull() | several, "ambiguous").otherwise("new-book")
    nothing = F.lit("fileless: no book has this title")
    # an own match, a folder whose books don't tell (shells are not looked at), then what the shells say, then the folder
    shut = F.col("here").isNull() & ~F.col("here_open")
    said = F.when(F.col("here").isNotNull() | shut, F.col("here_reason")).otherwise(F.coalesce("shell_reason", "here_reason", nothing))
    reason = (
        F.when(kept & F.col("follows"), "group: follows the files that it would be one book with")
        .when(kept, said)
        .when(claimed & (F.col("verdict") == "strong"), F.concat(F.lit("claims: yields to stronger ones, "), F.col("why")))
        .when(claimed, F.concat(F.lit("claims: "), F.col("why")))
        .otherwise(F.coalesce("why_group", said))
    )
    mine, weak_group = F.coalesce(F.col("own_rank") == 1, F.lit(False)), F.coalesce(F.col("top") == 1, F.lit(False))
    weak = (
        F.when(kept & weak_group, "attached")
        .when(kept & mine & (F.col("own") == F.col("final")), "agrees")
        .when(kept & mine, "yielded")
        .when(claimed & weak_group & (F.col("verdict") == "strong"), "yielded")
        .when((mine | weak_group) & ~kept, "lost")
        .otherwise("-")
    )
    target = F.coalesce(F.when(kept, F.col("final")).cast("string"), F.lit("-"))
    return out.select("file", decision.alias("decision"), target.alias("target"), "group_key", reason.alias("reason"), weak.alias("weak_match"))
