"""Cursors, chunks, the title index, recommendations and editions on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from tomelight.operators import paging, search
from tomelight.operators.resolve import hashed_weights, shared_folder, top_similar, weighted_features


def test_pages_join_to_the_whole_difference(spark):
    snapshots = {"s1": [(i, i % 3) for i in range(20)], "s2": [(i, i % 3 + (i % 5 == 0)) for i in range(4, 26)], "s3": [(i, 0) for i in range(6)]}
    frames = {k: spark.createDataFrame(v, "id long, v long") for k, v in snapshots.items()}
    calls = []

    def snapshot(name):
        calls.append(name)
        return frames[name]

    told, token, more = [], None, True
    while more:
        # a newer snapshot while pages are under way doesn't disturb them
        changes, token, more = paging.sync(snapshot, "s2" if not token else "s3", token, ["id"], ["v"], 5, seen="s1")
        assert len(changes) == 5 or not more
        told += [(c["change"], c["id"]) for c in changes]
    old, new = dict(snapshots["s1"]), dict(snapshots["s2"])
    wanted = [("added", i) for i in sorted(new.keys() - old.keys())] + [("changed", i) for i in sorted(new.keys() & old.keys()) if new[i] != old[i]] + [("removed", i) for i in sorted(old.keys() - new.keys())]
    assert told == wanted and "s3" not in calls
    # the next call begins at the newer snapshot, from the one that was told
    changes, token, _ = paging.sync(snapshot, "s3", token, ["id"], ["v"], 100)
    assert {c["change"] for c in changes} == {"added", "changed", "removed"} and token == '{"over":{"from":"s2","to":"s3"},"after":null}'
    assert paging.sync(snapshot, "s3", token, ["id"], ["v"]) == ([], '{"over":{"from":"s3","to":"s3"},"after":null}', False)
    # a reader that has nothing is told everything
    assert [c["change"] for c in paging.sync(snapshot, "s3", None, ["id"], ["v"], 100)[0]] == ["added"] * 6


def test_a_page_asked_for_again_is_the_same_page(spark):
    rows = spark.createDataFrame([(i % 3, f"k{i:02d}'\"") for i in range(12)], "a long, b string")
    first = paging.page_after(rows, ["a", "b"], 5).collect()
    again = paging.page_after(rows, ["a", "b"], 5, first[1].cursor).collect()
    assert [r.b for r in again][:3] == [r.b for r in first[2:]]
    # rows before the cursor may go without shifting what follows
    fewer = paging.page_after(rows.where("a > 0 or b > 'k05'"), ["a", "b"], 5, first[1].cursor).collect()
    assert {r.b for r in fewer} >= {r.b for r in again if r.a > 0}


def test_chunks_and_ranks(spark):
    rows = spark.createDataFrame([(i * 7 % 1003, f"t{i}") for i in range(1003)], "id long, t string").repartition(5)
    found = sorted(paging.chunks(rows, ["id"], 100).collect(), key=lambda r: r.chunk)
    assert [(r.chunk, r.n, r["first"], r["last"]) for r in found] == [(c, min(100, 1003 - 100 * c), 100 * c, min(100 * c + 99, 1002)) for c in range(11)]
    assert [x["id"] for part in paging.delivered(rows, ["id"], 100) for x in part] == list(range(1003))
    assert paging.chunks(rows.limit(0), ["id"]).count() == 0
    listed = paging.in_given_order(rows, "id", spark.createDataFrame([([5, 2, 9999, 5],)], "ids array<long>"))
    assert [(r.place, r.id) for r in listed.collect()] == [(0, 5), (1, 2), (3, 5)]


def test_title_index_reads_only_its_buckets(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    titles = [(i, " ".join(draw.choice(words[: draw.choice([5, 60])]) for _ in range(draw.randint(1, 6)))) for i in range(400)]
    rows = spark.createDataFrame([*titles, (900, None), (901, "")], "id long, title string")
    path = shared_folder(spark, "titles")
    search.build(rows, path, buckets=16)
    df = {w: sum(w in t.split() for _, t in titles) for w in words}
    for text in ("w1 w40 w59", "W2!", "absent w3", "absent", ""):
        asked = {w.strip("!").lower() for w in text.split()}
        scored = [(-round(sum(math.log(402 / df[w]) for w in asked & set(t.split())), 9), i) for i, t in titles if asked & set(t.split())]
        got = search.lookup(spark, path, text, [], 10, buckets=16)
        assert [r.id for r in got.collect()] == [i for _, i in sorted(scored)[:10]]
    plan = search.lookup(spark, path, "w1 w40", [], 10, buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<token:string,id:bigint,df:bigint,all:bigint>" in plan
    assert [r.id for r in search.scanned(rows, "W1 w", [], 5).collect()] == [i for i, t in titles if "w1 w" in t][:5]


def java(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_recommendations_equal_brute_force(spark):
    draw = random.Random(6)
    rows = []
    for i in range(90):
        title = " ".join(draw.choice(["Dark", "tower", "of", "the", "Ring's", "night", "night"]) for _ in range(draw.randint(1, 25)))
        rows.append((i, title if i % 17 else None, draw.sample(["Ann", "Bo", "ann", "Cy"], draw.randint(0, 3)), draw.choice(["Saga", "Epic", None]), draw.choice(["House", None])))
    frame = spark.createDataFrame(rows, "id long, title string, authors array<string>, series string, publisher string").repartition(3)
    alone = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    features = weighted_features([("title", F.col("title"), 3, 20), ("author", F.col("authors"), 5, None), ("series", alone("series"), 6, None), ("publisher", alone("publisher"), 2, None)])
    vectors = {}
    for i, title, authors, series, publisher in rows:
        weights = {}
        for w in [w for w in "".join(c if c.isalnum() and c.isascii() or c == " " else " " for c in (title or "").lower()).split() if len(w) > 3][:20]:
            weights[f"title_{w}"] = weights.get(f"title_{w}", 0) + 3
        weights |= {f"author_{a.lower()}": 5 for a in authors} | ({f"series_{series.lower()}": 6} if series else {}) | ({f"publisher_{publisher.lower()}": 2} if publisher else {})
        v = [0.0] * 128
        for k, w in weights.items():
            v[abs(java(k)) % 128] += w
        vectors[i] = v
    table = hashed_weights(frame, "id", features)
    assert {r.id: list(r.vector) for r in table.collect()} == vectors
    joined = table.join(frame.select("id", "series"), "id")
    found = {}
    for r in top_similar(joined, "id", "vector", joined, 5, query_rows=20, block_rows=25, apart="series").collect():
        found.setdefault(r.query, []).append((-r.score, r.other))
    series = {r[0]: r[3] for r in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v in vectors.items():
        others = [(-dot(v, w) / math.sqrt(dot(v, v) * dot(w, w)), j) for j, w in vectors.items() if j != i and dot(v, v) * dot(w, w) > 0 and not (series[i] and series[i] == series[j])]
        assert sorted(found.get(i, [])) == sorted(x for x in others if x[0] < -0.1)[:5]


def test_editions(spark):
    found = [(1, 0, "i", None, ["X"]), (2, 0, None, None, ["Ann Bee"]), (2, 1, "j", "k", ["Zed"]), (2, 2, None, "l", ["Bee, Ann"]), (3, 0, "m", None, None), (3, 1, "n", None, ["Q"]), (4, 0, "o", None, ["Al"]), (4, 1, "p", None, ["Bo"]), (5, 0, "q", None, ["Le"]), (5, 1, "r", None, ["Mr Le Guin"])]
    asked = [(1, ["Nobody"]), (2, ["Ann Bee"]), (3, None), (4, ["Someone Else"]), (5, ["Le Guin"]), (6, ["A"])]
    out = search.best_by_author(spark.createDataFrame(found, "query long, place int, isbn13 string, isbn10 string, authors array<string>"), spark.createDataFrame(asked, "query long, authors array<string>"))
    assert {r.query: (r.isbn13, r.isbn10, r.by) for r in out.collect()} == {1: ("i", None, "only"), 2: (None, "l", "author"), 3: ("m", None, "first"), 4: (None, None, "none"), 5: ("q", None, "author")}


def test_release_scores(spark):
    rows = [("Emma Jane Austen epub", 10, 9, "torrent", "Emma", "Jane Austen", 100), ("Emma Collection", 10, 0, "torrent", "Emma", None, 0), ("Emma Jane.mobi", 600 << 20, 1, "usenet", "Emma Two", "Jane Austen", 0), (None, 1, 1, "torrent", "a", "b", 0), ("The Sea", None, None, None, "of", " ", 0)]
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, size long, seeders int, protocol string, wanted string, author string, want int")
    score = search.release_score(*(F.col(c) for c in ("title", "size", "seeders", "protocol", "wanted", "author")))
    assert all(r.s == r.want for r in x.select("want", score.alias("s")).collect())


def test_results_of_several_providers(spark):
    rows = [
        (1, 0, "Emma", "Jane", " 9 ", None, None, None),
        (1, 1, "EMMA!", None, "9", "about", "url", 1815),
        (1, 2, "Emma", "Jane", "", None, None, None),
        (1, 3, "emma ", "JANE.", None, None, None, 1815),
        (1, 4, "Emma", "Jane", None, None, None, 1816),
        (1, 5, "The Emma", None, None, None, None, None),
        (1, 6, " ", "x", "7", None, None, None),
        (1, 7, None, "x", "7", None, None, None),
        (2, 0, "Emma", "Jane", "9", None, None, None),
    ]
    x = spark.createDataFrame(rows, "query long, place int, title string, author string, isbn13 string, description string, thumbnail string, year int")
    found = {(r.query, r.key): (r.place, r.richness, r.relevance) for r in search.merged_results(x, F.lit("Emma")).collect()}
    assert found == {(1, "isbn:9"): (1, 8, 28), (1, "ta:emma|jane"): (2, 4, 24), (1, "ta:the emma|"): (5, 0, 6), (2, "isbn:9"): (0, 4, 24)}


def test_presence_and_progress(spark):
    from tomelight.operators.rules import PRESENCE, column_of, presence, reading_progress

    assert len(PRESENCE) == 50 and len(set(map(column_of, PRESENCE))) == 50
    x = spark.createDataFrame([(1, " ", ["a"], None, 5.0), (2, "t", [], 0, None), (3, None, None, 3, 7.5)], "id int, title string, authors array<string>, page_count int, pdf_progress double")
    for c in ("koreader_progress", "kobo_progress", "epub_progress", "cbx_progress"):
        x = x.withColumn(c, F.lit(6.0) if c == "kobo_progress" else F.lit(None).cast("double"))
    assert [(r.p, r.g) for r in x.orderBy("id").select(presence(x).alias("p"), reading_progress().alias("g")).collect()] == [(["authors"], 6.0), (["title", "pageCount"], 6.0), (["pageCount"], 7.5)]
