"""Operators on small fixtures: nulls, blanks, ties, restrictions, merges, streams, files."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tomelight.functions import text as X
from tomelight.functions.identity import fuzzy_score, person, strength, title_identity
from tomelight.operators import matching, resolve, rules, scope, sets
from tomelight.operators.facets import Facet, facet_counts, natural_key
from tomelight.sources import files, outputs
from tomelight.streaming import moves, sessions, sinks

NOW = datetime.datetime(2024, 5, 15, 12)


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        (1, "Dune", "Saga", 1.0, ["Frank Herbert"], datetime.datetime(2024, 5, 14), True),
        (2, None, " ", None, None, None, None),
        (3, "50% off!", "", 3.5, [], datetime.datetime(2020, 1, 1), False),
        (4, "dune messiah", "Saga", 2.0, ["frank herbert", "Other"], datetime.datetime(2024, 5, 1), True),
    ]
    return spark.createDataFrame(rows, "id long, title string, series string, number double, authors array<string>, added timestamp_ntz, owned boolean")


def schema():
    return {
        "title": rules.Field(F.col("title"), "text"),
        "series": rules.Field(F.col("series"), "text"),
        "number": rules.Field(F.col("number"), "number"),
        "authors": rules.Field(F.col("authors"), "list"),
        "added": rules.Field(F.col("added"), "date"),
        "owned": rules.Field(F.col("owned"), "flag"),
    }


def ids(books, *leaves, join="and", dialect="default"):
    tree = {"type": "group", "join": join, "rules": [dict(zip(("field", "operator", "value", "valueStart", "valueEnd"), x, strict=False)) for x in leaves]}
    return [r.id for r in books.where(rules.compile_rule(json.dumps(tree), schema(), NOW, dialect)).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("leaf", "wanted"),
    [
        (("title", "equals", "DUNE"), [1]),
        (("title", "equals", None), [2]),
        (("title", "not_equals", "dune"), [2, 3, 4]),
        (("title", "contains", "50%"), [3]),
        (("title", "does_not_contain", "dune"), [2, 3]),
        (("series", "is_empty"), [2, 3]),
        (("series", "is_not_empty"), [1, 4]),
        (("authors", "is_empty"), [2, 3]),
        (("authors", "includes_any", ["FRANK HERBERT"]), [1, 4]),
        (("authors", "includes_all", ["frank herbert", "other"]), [4]),
        (("authors", "includes_all", []), [1, 2, 3, 4]),
        (("authors", "excludes_all", ["other"]), [1, 2, 3]),
        (("number", "greater_than", "1"), [3, 4]),
        (("number", "in_between", None, 1, 2), [1, 4]),
        (("added", "within_last", 7, None, "days"), [1]),
        (("added", "older_than", 1, None, "years"), [3]),
        (("added", "this_period", "month"), [1, 4]),
        (("owned", "equals", "true"), [1, 4]),
        (("nothing", "equals", 1), []),
        (("number", "greater_than", "x"), []),
    ],
)
def test_rule_leaves(books, leaf, wanted):
    assert ids(books, leaf) == wanted


def test_rule_groups_and_dialects(books):
    assert ids(books) == [1, 2, 3, 4]
    assert ids(books, join="or") == []
    assert ids(books, join="or", dialect="lenient") == [1, 2, 3, 4]
    assert ids(books, ("nothing", "equals", 1), dialect="lenient") == [1, 2, 3, 4]
    deep = {"type": "group", "join": "and", "rules": []}
    for _ in range(70):
        deep = {"type": "group", "join": "and", "rules": [deep]}
    assert books.where(rules.compile_rule(deep, schema(), NOW)).count() == 0
    assert books.where(rules.compile_rule("{broken", schema(), NOW)).count() == 0


def test_visibility_and_restrictions(spark):
    rows = spark.createDataFrame([(1, 1, None, ["A"], 12), (2, 1, True, ["A"], 12), (3, 2, False, ["b "], None), (4, 1, False, None, 18)], "id long, library_id long, deleted boolean, tags array<string>, age_rating int")
    seen = scope.visible(rows, spark.createDataFrame([(1,)], "library_id long"))
    assert sorted(r.id for r in seen.collect()) == [1, 4]
    assert sorted(r.id for r in scope.restricted(rows, {"tags": ["B"]}, {}, [18, 16]).collect()) == [1, 2]
    assert sorted(r.id for r in scope.restricted(rows, {}, {"tags": ["a"]}).collect()) == [1, 2]


def test_facets_ignore_their_own_filter(spark):
    rows = spark.createDataFrame([("x", ["a", "b"]), ("x", ["a"]), ("y", None), (None, ["b"])], "s string, t array<string>")
    facets = [Facet("s", F.col("s")), Facet("t", F.col("t"), many=True)]
    found = {(r.facet, r.value): r.n for r in facet_counts(rows, facets, {"t": ["a"]}).collect()}
    assert found == {("s", "x"): 2, ("t", "a"): 2, ("t", "b"): 2}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.search_key(F.lit("  Crème  Brûlée! Łódź ßtraße ")).alias("key"),
        X.isbn13(F.lit("0-306-40615-2")).alias("thirteen"),
        X.isbn10(F.lit("9780306406157")).alias("ten"),
        X.valid_isbn(F.lit("9780306406158")).alias("bad"),
        X.clean_file_name(F.lit("A_Book (x (y)).epub")).alias("name"),
        X.file_type(F.lit("/a/b.CBR")).alias("kind"),
        X.token_counts_cosine(F.lit(""), F.lit("a")).alias("none"),
        X.jaccard(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"))).alias("half"),
        natural_key(F.lit("v10")).alias("later"),
        natural_key(F.lit("v9")).alias("sooner"),
    ).first()
    assert (row.key, row.thirteen, row.ten, row.bad, row.name, row.kind, row.none, row.half) == ("creme brulee lodz sstrasse", "9780306406157", "0306406152", False, "A Book", "cbx", 0.0, 0.5)
    assert row.sooner < row.later


def test_staged_duplicates_and_keepers(spark):
    rows = spark.createDataFrame([(1, "i1", None), (2, "i1", "g1"), (3, None, "g1"), (4, None, "g2"), (5, None, None)], "id long, isbn string, ext string")
    found = {r.id: r.group_id for r in resolve.staged_duplicates(rows, "id", [("ids", F.array(F.concat(F.lit("isbn:"), "isbn"), F.concat(F.lit("ext:"), "ext")))]).collect()}
    assert found == {1: 1, 2: 1, 3: 1}
    ranked = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 9)], "g string, id long, score int")
    assert resolve.keepers(ranked, "g", [F.col("score")], "id").first().keeper == 2


def test_merge_and_changes(spark):
    rows = spark.createDataFrame([(1, "a", " ", "x"), (1, "b", "t", None)], "id long, provider string, title string, lang string")
    assert resolve.merged_by_priority(rows, "id", "provider", {"title": ["a", "b"], "lang": ["b", "a"]}).first()[1:] == ("t", "x")
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    assert {r.id: r.change for r in sets.compare(old, new, ["id"], ["v"]).collect()} == {1: "same", 2: "changed", 3: "added"}
    assert resolve.consolidated(spark.createDataFrame([(1, ["a", "b", "c"])], "id long, tags array<string>"), "tags", spark.createDataFrame([("a", "c"), ("b", None)], "old string, new string")).first().tags == ["c"]


def test_session_capture_drops_short_ones(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 1.0), (1, t + datetime.timedelta(seconds=40), 2.0), (1, t + datetime.timedelta(hours=1), 3.0)]
    found = sessions.captured_sessions(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")).collect()
    assert [(r.events, r.value, r.seconds) for r in found] == [(2, 3.0, 40)]


def test_streamed_sessions(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 1.0), (1, t + datetime.timedelta(seconds=60), 2.0), (2, t + datetime.timedelta(hours=2), 1.0), (2, t + datetime.timedelta(hours=2, seconds=50), 1.0)]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = sessions.captured_sessions(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("captured").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert [(r.user_id, r.events) for r in spark.table("captured").collect()] == [(1, 2)]


def test_moves_are_resolved_from_deletes(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    s = lambda n: t + datetime.timedelta(seconds=n)
    first = [("delete", "/a", "h1", s(0)), ("create", "/b", "h1", s(3)), ("delete", "/c", "h2", s(1))]
    schema = "event string, path string, content_hash string, event_time timestamp"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("create", "/z", "h9", s(100))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = moves.resolve_moves(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("moved").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(90)
    found = {(r.action, r.old_path, r.new_path) for r in spark.table("moved").collect()}
    assert ("move", "/a", "/b") in found
    assert ("create", None, "/z") in found


def test_folder_moves(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("k", "9")], "folder string, content_hash string")
    new = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "3"), ("k", "9")], "folder string, content_hash string")
    assert [(r.old_folder, r.new_folder) for r in moves.moved_folders(old, new).collect()] == [("a", "b")]


def test_upsert_sink(spark, tmp_path):
    write = sinks.upsert_batches(str(tmp_path / "t"), ["id"], "at")
    write(spark.createDataFrame([(1, 1, "a")], "id long, at long, v string"), 0)
    write(spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "id long, at long, v string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v000000001")).collect()) == [(1, 2, "b"), (2, 1, "c")]


def test_rescan_after_lost_events(spark):
    known = spark.createDataFrame([("/a", 1, 5), ("/b", 2, 5), ("/c", 3, 5)], "path string, length long, modificationTime long")
    fresh = spark.createDataFrame([("/a", 1, 5), ("/b", 2, 9), ("/d", 4, 9)], "path string, length long, modificationTime long")
    assert {(r.path, r.change) for r in sinks.rescanned(known, fresh).collect()} == {("/b", "changed"), ("/c", "removed"), ("/d", "added")}


def test_titles_and_people(spark):
    titles = {
        "The Saga, Vol. II (Unabridged) (2)": ("saga 2 2", 2, [], "saga 2"), "Dune (1965)": ("dune", None, ["1965"], "dune"), "Book One - Copy": ("1 1", 1, [], "1"), "A Tale of Two Cities Part 03": ("tale of two cities 3", None, [], "tale of two cities 3"),
        "Rocky III": ("rocky 3", None, [], "rocky 3"), "I, Robot #4": ("i robot 4", None, [], "i robot 4"), "(Digital)": ("", None, [], ""),
    }
    for name, wanted in titles.items():
        found = spark.range(1).select(title_identity(F.lit(name)).alias("t")).first().t
        assert (found.identity, found.copy, found.years, found.without_copy) == wanted, name
    people = [("Ursula K. Le Guin", "Le Guin, Ursula", 2), ("Yeats, W. B.", "William Yeats", 2), ("Smith", "J. Smith Jr.", 1), ("O'Neil, Ann", "Bob ONeil", 0), ("", "x", 0), (None, "A Bee", 0), ("Simone de Beauvoir", "Beauvoir, S. de", 2)]
    for a, b, wanted in people:
        assert spark.range(1).select(strength(person(F.lit(a).cast("string")), person(F.lit(b))).alias("s")).first().s == wanted, (a, b)
    for term, query, wanted in (("room", "o", 1), ("workshop", "ws", 2), ("workshop", "wo", 4), ("apache software foundation", "asf", 3), ("a", "zzz", 0)):
        assert spark.range(1).select(fuzzy_score(F.lit(term), F.lit(query)).alias("s")).first().s == wanted


def test_books_of_one_folder(spark):
    rows = [(1, 1, "Dune (1965).epub", None), (2, 1, "Dune (2021).epub", None), (3, 1, "Dune.epub", None), (4, 1, "Saga (1).cbz", None), (5, 1, "Saga (2).cbz", None), (6, 1, "Emma.epub", None), (7, 1, "Emma (1).epub", None), (8, 1, "EMMA - Copy.mobi", None), (9, 2, "Emma.epub", None)]
    rows += [(10, 3, "Poems.epub", "W. B. Yeats"), (11, 3, "Poems.pdf", "T. S. Eliot"), (12, 3, "Poems.mobi", None), (13, 3, "poems.azw3", "William Yeats"), (14, 4, "(Digital).cbz", None), (15, 4, "(Retail).cbz", None)]
    found = {r.file: r.group_key for r in matching.grouped(spark.createDataFrame(rows, "file long, folder long, name string, author string")).collect()}
    assert len({found[i] for i in (1, 2, 3)}) == 3 and found[4] != found[5] and found[6] == found[7] == found[8] != found[9] and found[14] != found[15]
    # one base name in four formats, so one book whatever the authors say
    assert found[10] == found[11] == found[12] == found[13]


def test_matching_of_files(spark):
    schema = "file long, folder long, name string, author string"
    new = [(1, 1, "Dune.epub", None), (2, 2, "Emma (1).epub", "Jane Austen"), (3, 3, "Ilium.epub", "Dan Simmons"), (4, 4, "Ilium.pdf", "D. Simmons"), (5, 5, "Nope.epub", None), (6, 6, "Dune.epub", "F. Herbert"), (7, 7, "It.epub", "King"), (8, 7, "It.mobi", "Stephen King")]
    existing = spark.createDataFrame([(90, 1, "Dune (1).epub", None, 500), (91, 2, "Emma.pdf", None, 501)], schema + ", book long").union(spark.createDataFrame([(92, 1, "DUNE.mobi", None, 500)], schema + ", book long"))
    shells = spark.createDataFrame([(700, "Ilium", "Simmons, Dan"), (701, "Dune", "Frank Herbert"), (702, "Dune", "Frank Herbert"), (703, "It", "Stephen King")], "shell long, name string, author string")
    found = {r.file: (r.decision, r.target) for r in matching.decided(spark.createDataFrame(new, schema), existing, shells).collect()}
    assert found == {
        1: ("attach-same-folder", "500"), 2: ("attach-same-folder", "501"), 3: ("ambiguous", "-"), 4: ("ambiguous", "-"), 5: ("new-book", "-"), 6: ("ambiguous", "-"), 7: ("ambiguous", "-"), 8: ("attach-shell", "703"),
    }


def test_book_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A B</dc:creator><dc:language>en</dc:language></metadata><spine><itemref/><itemref/></spine></package>')
    with zipfile.ZipFile(tmp_path / "c.cbz", "w") as z:
        z.writestr("ComicInfo.xml", "<ComicInfo><Title>C</Title><Writer>X, Y</Writer><Number>3</Number></ComicInfo>")
        z.writestr("1.jpg", b"")
    (tmp_path / "bad.epub").write_bytes(b"no")
    (tmp_path / "f.fb2").write_text("<FictionBook><description><title-info><book-title>F</book-title><author><first-name>N</first-name><last-name>M</last-name></author></title-info></description></FictionBook>")
    rows = {r.path.rpartition("/")[2]: r for r in files.book_metadata(spark, str(tmp_path)).collect()}
    assert (rows["a.epub"].title, rows["a.epub"].authors, rows["a.epub"].pages) == ("T", ["A B"], 2)
    assert (rows["c.cbz"].title, rows["c.cbz"].authors, rows["c.cbz"].pages) == ("C", ["X", "Y"], 1)
    assert rows["bad.epub"].error and rows["f.fb2"].authors == ["N M"]
    assert files.listing(spark, str(tmp_path)).count() == 4


def test_pages_and_feeds(spark):
    rows = spark.createDataFrame([(i, f"t<{i}>") for i in range(5)], "id long, title string")
    found = outputs.page(rows, [F.col("id")], 1, 2)
    assert (found["totalElements"], found["totalPages"], found["first"], found["last"], len(found["content"])) == (5, 3, False, False, 2)
    assert "t&lt;2&gt;" in outputs.atom_feed("x", "/l", found)
    assert len(json.loads("".join(outputs.json_array(rows)))) == 5
