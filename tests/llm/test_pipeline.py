"""The pipeline on a small corpus: each stage's decisions take effect and columns stay."""

import collections
import random
import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ["zorgface", "plimwit", "kruddle", "vexhead"]


def test_stages_in_order(spark, tmp_path):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice(["an", "er", "th", "on", "re", "sh", "ble", "ing"]) for _ in range(draw.randint(1, 4)))
    texts, toxic = [], []
    for i in range(500):
        words = [word() for _ in range(draw.randint(30, 120))]
        toxic.append(i % 4 == 0)
        for _ in range(4 if toxic[-1] else 0):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        texts.append(" ".join(words))
    texts += [texts[1] + "\n", texts[2].replace(" ", "\n"), " ".join(["changed", *texts[5].split(" ")[1:]]), None]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    clean = {r.doc_id for r in seen["toxicity"]}
    assert sum(i in clean for i in range(500) if toxic[i]) <= 6 and sum(i not in clean for i in range(500) if not toxic[i]) <= 12
    exact = {r.doc_id for r in seen["exact_dedup"]}
    assert len(exact & {1, 500}) == 1 and len(exact & {2, 501}) == 1 and {r.doc_id: r.text for r in seen["exact_dedup"] if r.doc_id is not None}.get(3) == texts[3]
    near = {r.doc_id for r in seen["minhash_dedup"]}
    assert near <= exact and not {5, 502} <= near and (5 in near or 502 in near)
    words = collections.Counter()
    for r in seen["mixing"]:
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * len(WORD.findall(texts[i])) for i, n in words.items())
    total = sum(len(WORD.findall(texts[i] or "")) for i in near)
    assert abs(sum(words.values()) - total) <= 3
    tokens = collections.Counter()
    for r in seen["packing"]:
        tokens[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert max(tokens.values()) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "packing"]


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
