"""Title identities: remarks on editions, ordinals, comics; byte budgets and date forms of paths and file names."""

import pytest
from pyspark.sql import functions as F

from tomelight.functions.identity import title_identity

SAME = [
    ("Emma (A Digital Life)", "emma digital life", False),
    ("Emma (Illustrated Edition)", "emma", False),
    ("Emma [20th Anniversary Edition]", "emma", False),
    ("Emma (Special)", "emma special", False),
    ("The Complete Sherlock Holmes", "complete sherlock holmes", False),
    ("The Stand: Complete and Uncut Edition", "stand", False),
    ("The Hobbit Unabridged", "hobbit", False),
    ("Neuromancer 20th Anniversary", "neuromancer", False),
    ("Going Digital", "going digital", False),
    ("Mister Ed", "mister ed", False),
    ("Audiobook The Hobbit", "hobbit", False),
    ("The Illustrated Man", "illustrated man", False),
    ("Kindle the Flame", "kindle flame", False),
    ("Magnum Opus", "magnum opus", False),
    ("Dune - Unabridged", "dune", False),
    ("Unabridged", "unabridged", False),
    ("Dune e-book (v5.0)", "dune", False),
    ("Dune (Graphic Novel)", "dune graphic novel", False),
    ("Dune_Messiah [epub]", "dune messiah", False),
    ("Saga Book Second", "saga 2", False),
    ("Saga 2nd", "saga 2", False),
    ("Saga v03", "saga 3", False),
    ("Saga No. Two", "saga no two", False),
    ("Rick & Morty Part II", "rick and morty 2", False),
    ("Saga 001", "saga i1", True),
    ("Saga #1", "saga i1", True),
    ("Saga Vol. 1", "saga 1", True),
    ("Saga v01", "saga 1", True),
    ("Saga Volume 1 (Deluxe Edition)", "saga 1 deluxe edition", True),
    ("Saga Volume 1 (Digital)", "saga 1", True),
    ("Saga Volume 1 (Deluxe Edition)", "saga 1", False),
    ("(Retail)", "", False),
    ("", "", False),
]


def test_remarks_ordinals_and_comics(spark):
    rows = spark.createDataFrame([(i, n, c) for i, (n, _, c) in enumerate(SAME)], "i int, name string, comic boolean")
    found = {r.i: r.identity for r in rows.select("i", title_identity(F.col("name"), F.col("comic")).alias("t")).select("i", "t.identity").collect()}
    assert {SAME[i][0] + str(SAME[i][2]): v for i, v in found.items()} == {n + str(c): w for n, w, c in SAME}


NAMES = [
    ("{Title} - {Authors} ({Published})", "Emma - Ann Bee, Cy Dee (1999)", {"Title": "Emma", "Authors": ["Ann Bee", "Cy Dee"], "Published": "1999-01-01"}),
    ("{Title} - {Published:dd.MM.yyyy}", "Emma - 07.03.2001", {"Title": "Emma", "Published": "2001-03-07"}),
    ("{Title} - {Published:dd.MM.yyyy}", "Emma - 7.3.2001", None),
    ("{SeriesName} #{SeriesNumber} of {SeriesTotal} - {Title}", "Saga #1.5 of 12 - A - B", {"SeriesName": "Saga", "SeriesNumber": 1.5, "SeriesTotal": 12, "Title": "A - B"}),
    ("*{ISBN13}*{Language}", "x 9780000000001 en", {"ISBN13": "9780000000001", "Language": "en"}),
    ("{Title} [{ASIN}]", "Emma [B00AAAAAAA]", {"Title": "Emma", "ASIN": "B00AAAAAAA"}),
    ("{Title}", "Emma", {"Title": "Emma"}),
]
DATES = [("1999", "1999-01-01"), ("49", "2049-01-01"), ("50", "1950-01-01"), ("20010307", "2001-03-07"), ("2001-3", "2001-03-01"), ("3/2001", "2001-03-01"), ("2001.03.07", "2001-03-07"), ("2001-25-12", "2001-12-25"), ("7-3-2001", "2001-03-07"), ("12-25-2001", "2001-12-25")]
DATES += [("25-12-2001", "2001-12-25"), ("7/3/01", "2001-03-07"), ("99-03-07", "2099-03-07"), ("2001-02-30", "2001-02-28"), ("2001-13-13", None), ("2001x03x07", None), ("none", None), ("", None), (None, None), ("2001-3/7", None)]


def test_patterns_and_dates(spark):
    from tomelight.functions.filedates import any_date, date_by_form, pattern_fields

    for pattern, name, wanted in NAMES:
        got = spark.createDataFrame([(name,)], "n string").select(pattern_fields(F.col("n"), pattern).alias("f")).first().f
        assert (got and {k: str(v) if k == "Published" else v for k, v in got.asDict().items()}) == wanted
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    assert {DATES[r.i][0]: r.d and str(r.d) for r in rows.select("i", any_date(F.col("t")).alias("d")).collect()} == dict(DATES)
    assert str(spark.range(1).select(date_by_form(F.lit("3/99"), "M/yy").alias("d")).first().d) == "2099-03-01"


@pytest.mark.parametrize("text, most, wanted", [
    ("plain", 10, "plain"), ("plain text", 6, "plain"), ("ééé", 5, "éé"), ("漢字漢字", 7, "漢字"), ("ééé", 7, "éé"), ("a" + "́" * 9, 6, "á́"),
    ("ab‍‍cdefgh", 9, "ab‍‍c"), ("ab ‌ more", 6, "ab"), ("😀😀", 5, "😀"), ("", 3, ""), ("\n\nab", 1, ""),
])
def test_byte_budget(spark, text, most, wanted):
    from tomelight.functions.filedates import within_bytes

    assert spark.createDataFrame([(text,)], "t string").select(within_bytes(F.col("t"), most).alias("x")).first().x == wanted


def test_paths_and_author_lists(spark):
    from tomelight.functions.filedates import authors_within, path_within

    rows = spark.createDataFrame([("A" * 300 + "/" + "é" * 200 + ".epub", "Ann, " * 50 + "Bo", "X" * 300), ("a./b..//c.d", "Ann, Bo", "Ann")], "p string, a string, b string")
    found = rows.select(path_within(F.col("p")).alias("p"), authors_within(F.col("a")).alias("a"), authors_within(F.col("b")).alias("b")).collect()
    assert found[0].p == "A" * 245 + "/" + "é" * 120 + ".epub" and found[1].p == "a/b/c.d"
    assert found[0].a == ", ".join(["Ann"] * 36) + " et al." and found[0].b == "X" * 173 + " et al." and (found[1].a, found[1].b) == ("Ann, Bo", "Ann")
