"""Pipeline stages on rows without ids, repeated ids, long texts and columns of their own."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tomelight.llm import mixing, packing
from tomelight.llm.exact_dedup import drop_exact_copies
from tomelight.llm.minhash_dedup import drop_near_copies, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `gone.id` string, h double, component int"


def words(seed, n=60):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def near(text):
    return "changed " + text.split(" ", 1)[1]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{n % 2}", len(t or ""), str(n), 0.5, n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_rows_of_a_component_and_not_of_an_id(spark):
    a, b, c, d = (words(i) for i in range(4))
    rows = [(5, a), (7, near(a)), (7, b), (None, near(near(a) + " x")), (None, c), (None, near(c)), (None, near(c)), (9, d), (9, near(d)), (9, d), (None, None), (None, ""), (3, "   ")]
    docs = table(spark, rows)
    kept = [(r.doc_id, r.text) for r in drop_near_copies(docs).collect()]
    counts = collections.Counter(kept)
    assert counts[5, a] == 1 and counts[7, near(a)] == 0 and counts[7, b] == 1
    assert sum(n for (i, t), n in counts.items() if i is None and t and "changed" not in t) + sum(n for (i, t), n in counts.items() if i is None and t and "changed" in t) == 1
    assert counts[9, d] + counts[9, near(d)] == 1
    # rows without a set are linked with nothing
    assert counts[None, None] == counts[None, ""] == counts[3, "   "] == 1
    assert drop_near_copies(docs).columns == docs.columns
    assert near_duplicates(docs).count() == len(rows)


def test_only_rows_without_ids(spark):
    docs = table(spark, [(None, words(1))] * 5 + [(None, near(words(1)))] * 3)
    assert drop_near_copies(docs).count() == 1 and drop_exact_copies(docs).count() == 2


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    bad = ["zorgface", "plimwit", "kruddle", "vexhead"]
    rows, draw = [], random.Random(2)
    for i in range(300):
        text = words(i, draw.randint(30, 90)).split(" ")
        for _ in range(4 if i % 4 == 0 else 0):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((i, " ".join(text)))
    rows += [(None, words(900)), (None, words(901)), (None, None), (None, words(900)), (11, words(902)), (11, near(words(11, 60))), (500, "x" * 300_000), (501, words(77, 40_000)), (502, words(77, 40_000) + "\n"), (503, "")]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_all_stages_keep_columns_and_clean_rows(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    columns, seen = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, odd_corpus).write.parquet(f"{odd_corpus}/{name}")
        docs = seen[name] = spark.read.parquet(f"{odd_corpus}/{name}")
        assert name == "packing" or docs.columns == columns
    ids = {name: collections.Counter(r.doc_id for r in frame.select("doc_id").collect()) for name, frame in seen.items()}
    assert ids["toxicity"][None] == 4 and ids["toxicity"][11] == 3 and not {500, 501, 502, 503} - ids["toxicity"].keys()
    assert ids["exact_dedup"][None] == 2 and len({501, 502} & ids["exact_dedup"].keys()) == 1
    assert ids["minhash_dedup"][None] == 2 and 500 in ids["minhash_dedup"]
    assert seen["mixing"].where("doc_id is null").count() > 0
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_packing_spreads_one_text_without_ids(spark):
    hot = words(1, 40)
    rows = [(None, hot)] * 300 + [(i, words(10 + i, 40)) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = packing.pack(table(spark, rows)).withColumn("task", F.spark_partition_id())
        tasks = [r.n for r in out.where("doc_id is null").groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(tasks) >= 300 and max(tasks) < 250


def joins_of_blocks(frame):
    text = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in text.splitlines() if "Join" in line and "block" in line]


def test_blocks_of_the_mix_are_not_broadcast(spark):
    # one source's slots are a few runs, and a text is one row: both became thousands of rows that the driver collected
    docs = table(spark, [(i, words(i, 2000)) for i in range(20)])
    documents, slots = mixing.mix(docs)
    pieces = mixing.taken_pieces(packing.materialize(documents), slots)
    # each of the two targets is rounded down
    assert 0 <= 40_000 - sum(r.words for r in pieces.collect()) < 2
    joins = joins_of_blocks(pieces)
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_mixing_stage_broadcasts_no_blocks(spark):
    rows = [(i, words(i, 2000)) for i in range(20)]
    out = corpus_pipeline.mixing(spark, table(spark, rows), "")
    found = out.collect()
    assert 0 <= 40_000 - sum(len(r.text.split()) for r in found) < 2
    joins = joins_of_blocks(out)
    assert joins and all("SortMergeJoin" in line for line in joins)
