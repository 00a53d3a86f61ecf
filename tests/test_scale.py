"""Queries whose cost once grew faster than their input: the rows on small tables, and what the plan may not hold."""

import random

import duckdb
from pyspark.sql import functions as F

from tomelight.functions.identity import fuzzy_ratio, fuzzy_score, person, strength
from tomelight.functions.text import isbn10, isbn13, valid_isbn
from tomelight.operators import matching, resolve
from tomelight.operators.resolve import top_similar, top_similar_classes
from tomelight.operators.verdicts import read_names
from tomelight.plans import ORACLES, QUERIES, lookups


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def both(spark, folder, name):
    """(rows by Spark, rows by SQL) of a query over the Parquet tables in a folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, found.collect()), key=repr), sorted(wanted.fetchall(), key=repr)


def tables(folder, **sql):
    for name, text in sql.items():
        duckdb.execute(f"COPY ({text}) TO '{folder}/{name}.parquet'")


def test_tracks_pass_as_a_stream(spark, tmp_path):
    tables(tmp_path, events="SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i * 37 % 4000) AS ts, i % 3 AS user_id, CAST(CASE i % 7 WHEN 0 THEN 900 ELSE i * 13 % 90 END AS DOUBLE) AS value FROM range(400) r(i)")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a day spans many batches
    try:
        found, wanted = both(spark, tmp_path, "session_tracks")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == wanted
    # a Python call a user's day made the time of 2.4 million days
    assert "FlatMapGroups" not in plan(QUERIES["session_tracks"](spark, str(tmp_path)))


def test_isbns_read_their_text_once(spark):
    nine = F.lpad(F.col("id").cast("string"), 9, "0")
    thirteen = isbn13(F.concat(nine, F.lit("0")))
    ten = isbn10(thirteen)
    frame = spark.range(3).select(ten.alias("ten"), thirteen.alias("thirteen"), valid_isbn(ten).alias("a"), valid_isbn(F.concat(F.lit("x"), thirteen)).alias("b"))
    assert [tuple(r) for r in frame.collect()] == [("0000000000", "9780000000002", True, False), ("0000000019", "9780000000019", True, False), ("0000000027", "9780000000026", True, False)]
    assert spark.range(1).select(isbn13(F.lit("12345")).alias("a"), isbn10(F.lit("9790000000001")).alias("b"), valid_isbn(F.lit(None).cast("string")).alias("c")).first() == (None, None, False)
    # the text of each level stood some ten times in the next one's expression
    assert str(valid_isbn(ten)._jc).count("lpad") == 1


def test_persons_are_read_once(spark):
    frame = spark.createDataFrame([("Ann Bee", "A. Bee"), ("Ann Bee", "Bee"), ("Ann Bee", "Bob Bee"), ("Ann Bee", None)], "a string, b string")
    found = strength(person(F.col("a")), person(F.col("b")))
    assert [r[0] for r in frame.select(found).collect()] == [2, 1, 0, 0]
    # a person stood six times in a strength, and its reading is the work
    assert str(found._jc).count("jr") == str(F.struct(person(F.col("a")), person(F.col("b")))._jc).count("jr")


def test_a_word_scores_itself_in_closed_form(spark):
    frame = spark.createDataFrame([("",), ("a",), ("aab\U0001f600b",), ("small ring",)], "a string")
    a = F.col("a")
    for r in frame.select(a, fuzzy_score(a, a).alias("score"), fuzzy_ratio(a, a).alias("ratio"), F.length(a).alias("n")).collect():
        assert (r.score, r.ratio) == ((3 * r.n - 2, 1.0) if r.a else (0, 0.0))
    # the ratio alone scored five times; a letter was looked for six times a step
    assert str(fuzzy_ratio(a, a)._jc).count("locate") == 1


def test_pairs_of_a_block_are_scored_by_lists(spark, tmp_path):
    # 300 items of one block, of which 200 say the same and fill several lists; an item without a price, blocks of one
    tables(tmp_path, part="SELECT CAST(i * 7 % 307 AS BIGINT) AS p_partkey, CASE WHEN i < 300 THEN 'B' WHEN i = 306 THEN NULL ELSE 'C' END AS p_brand, CAST(CASE WHEN i < 300 THEN 1 ELSE i END AS INTEGER) AS p_size, CASE WHEN i < 200 THEN 'BIG TIN' ELSE 'tin x' || i % 5 END AS p_type, CAST(CASE WHEN i < 200 THEN 9 ELSE i % 11 END AS DOUBLE) AS p_retailprice FROM range(307) r(i)")
    found, wanted = both(spark, tmp_path, "pairwise_similarity")
    assert len(wanted) == 300 * 299 // 2
    assert found == wanted
    # words were compared for every pair of rows: now before lists become pairs
    text = plan(QUERIES["pairwise_similarity"](spark, str(tmp_path)))
    assert text.index("Generate explode(right") < text.index("array_intersect")


def test_only_different_vectors_meet(spark):
    draw = random.Random(3)
    kinds = [[float(draw.randint(0, 3)) for _ in range(4)] for _ in range(9)] + [[0.0] * 4]
    rows = [(i, kinds[i * i % 10], [None, "a", "b"][i % 3]) for i in draw.sample(range(1000), 200)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, s string").repartition(3)
    order = lambda x: sorted((r.query, -r.score, r.other) for r in x.collect())
    for apart in (None, "s"):
        found = top_similar_classes(frame, "id", "v", 5, query_rows=8, block_rows=11, apart=apart)
        assert order(found) == order(top_similar(frame, "id", "v", frame, 5, apart=apart))


def test_recommendations_meet_by_classes(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(resolve, "top_similar", lambda vectors, *rest, **more: seen.append(vectors.count()) or top_similar(vectors, *rest, **more))
    tables(tmp_path, part="SELECT CAST(i + 210 * j AS BIGINT) AS p_partkey, 'small ring' AS p_name, 'Brand#' || i % 3 AS p_brand, 'BIG TIN' AS p_type, CAST(i % 4 AS INTEGER) AS p_size, 1.0 AS p_retailprice FROM range(40) r(i), range(8) s(j)")
    found, wanted = both(spark, tmp_path, "recommendations_all")
    assert found == wanted
    # all 320 rows were shipped to meet all others
    assert seen and max(seen) <= 40


def test_best_vectors_over_many_columns_equal_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    # most rows are of four kinds (thousands of equal scores), the others whole numbers or not; a row of zeros, one that is not a number
    v = draw.integers(0, 4, (9000, 6)).astype(float)
    v[::2] = v[draw.integers(0, 4, 4500) * 2 + 1]
    v[5::7] += draw.random((len(v[5::7]), 6))
    v[3], v[11] = 0, np.nan
    named = [None, "a", "b", "c"]
    ids = draw.permutation(9000).tolist()
    frame = spark.createDataFrame([(i, x.tolist(), named[i % 4]) for i, x in zip(ids, v, strict=True)], "id long, v array<double>, s string").repartition(3)
    asked = [i for i in ids if i % 60 < 2]
    found = top_similar(frame, "id", "v", frame.where("id % 60 < 2"), 5, apart="s").collect()
    at = {i: n for n, i in enumerate(ids)}
    squares, group = (v * v).sum(1), np.array(ids) % 4
    wanted = {}
    for i in asked:
        n = at[i]
        scores = (v * v[n]).sum(1) / np.sqrt(np.where(squares * squares[n] > 0, squares * squares[n], 1))
        scores[(group == group[n]) & (group > 0)] = -2
        scores[n] = -2
        wanted[i] = sorted((-x, o) for o, x in zip(ids, scores.tolist(), strict=True) if x > 0.1)[:5]
    got = {i: [] for i in asked}
    for r in found:
        got[r.query].append((-r.score, r.other))
    whole = {i for i in asked if (v[at[i]] % 1 == 0).all()}
    # a sum of parts depends on its order in the last digit, one of whole numbers does not
    short = lambda x: {i: [(round(s, 9), o if i in whole else 0) for s, o in sorted(r)] for i, r in x.items()}
    assert len(whole) > 200 and short(got) == short(wanted)


def test_pairs_of_blocks_have_tasks_of_their_own(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(100)], "id long, v array<double>")
    # 25 pairs of blocks fell on the session's four tasks
    text = plan(top_similar(frame, "id", "v", frame, 5, query_rows=20, block_rows=20))
    assert text.count(", 50), REPARTITION_BY_NUM") == 2


def test_recommendations_widen_classes_and_read_in_all_tasks(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(lookups, "written", lambda df: seen.append(df) or resolve.written(df))
    tables(tmp_path, part="SELECT CAST(i + 210 * j AS BIGINT) AS p_partkey, 'small ring' AS p_name, 'Brand#' || i % 3 AS p_brand, 'BIG TIN' AS p_type, CAST(i % 4 AS INTEGER) AS p_size, 1.0 AS p_retailprice FROM range(40) r(i), range(8) s(j)")
    found, wanted = both(spark, tmp_path, "recommendations_all")
    assert found == wanted
    # one task read the whole file's features, and each row was written as 128 numbers
    assert "REPARTITION_BY_NUM" in plan(seen[0])
    assert max(len(r.entries) for r in seen[0].collect()) < 20


def test_names_of_files_are_read_once(spark):
    kinds = [("The Ring Vol. 2 (1999).epub", "Ann Bee"), ("The Ring Vol. 2 (1).mobi", None), ("Comic 7.cbz", "Bee, Ann"), (None, "Ann Bee"), ("", None)]
    rows = [(i, *kinds[i * i % 5]) for i in range(60)]
    found = read_names(spark.createDataFrame(rows, "file long, name string, author string"))
    alone = {k: read_names(spark.createDataFrame([(0, *k)], "file long, name string, author string")).drop("file").first() for k in kinds}
    got = found.collect()
    assert sorted(r.file for r in got) == list(range(60))
    assert all(tuple(r)[1:] == tuple(alone[r.name, r.author]) for r in got)
    # every row's name was read
    assert "HashAggregate(keys=[name" in plan(found)


def test_grouped_files_meet_as_classes(spark, monkeypatch):
    rows = [(i, i % 2, ("Dune.epub", "Dune (1).epub", "DUNE - Copy.mobi", "Emma (1815).epub")[i % 4], ("F. Herbert", None)[i % 8 // 4]) for i in range(400)]
    files = spark.createDataFrame(rows, "file long, folder long, name string, author string")
    sizes = []
    keep = matching.written
    monkeypatch.setattr(matching, "written", lambda df: [t := keep(df), sizes.append(t.count())][0])
    found = {r.file: (r.group_key, r.members) for r in matching.grouped(files).collect()}
    assert len(found) == 400 and found[0] == found[2] != found[1] and found[0][1] == 200 and {found[i] for i in (1, 5)} == {("1:dune 1", 100)}
    # what is written and shuffled between are classes of (folder, name, author), not files
    assert max(sizes) == 8


def test_capped_recommendations_sort_in_tasks_of_bounded_size(spark, tmp_path):
    scored = spark.createDataFrame([(i % 3, i, [f"a{i % 5}"], float(i)) for i in range(60)], "target long, item long, authors array<string>, score double").repartition(2, "target", "item")
    capped = resolve.capped_per_author(scored, "target", "authors", count=200_000_000)
    assert "REPARTITION_BY_NUM" in plan(capped) and ", 400), REPARTITION_BY_NUM" in plan(capped)
    assert capped.count() == 3 * 5 * 3


def test_a_name_that_reads_as_shells_does_not_refuse(spark, tmp_path):
    # one name by two authors: the folder has two books of the first one, whose shell is no match then, and the group's shell is the other's
    parts = "SELECT CAST(i AS BIGINT) AS p_partkey, 'small ring' AS p_name, 'BIG' AS p_type, 7 AS p_size FROM (VALUES (1), (6), (26), (51)) r(i)"
    orders = "SELECT CAST(i AS BIGINT) AS o_orderkey, CAST(j AS BIGINT) AS o_custkey, 2.0 AS o_totalprice, TIMESTAMP '1999-01-01' AS o_orderdate FROM (VALUES (0, 51), (3936, 6), (328, 1), (369, 26)) r(i, j)"
    tables(tmp_path, part=parts, orders=orders, nation="SELECT CAST(i AS INTEGER) AS n_nationkey, 'NATION_' || i AS n_name FROM range(25) r(i)", customer="SELECT CAST(i AS BIGINT) AS c_custkey FROM (VALUES (6), (51)) r(i)")
    found, wanted = both(spark, tmp_path, "rescan_verdicts")
    assert {r[0]: r[1:3] for r in wanted} == {0: ("attach-shell", "6"), 3936: ("attach-shell", "6")}
    assert found == wanted
