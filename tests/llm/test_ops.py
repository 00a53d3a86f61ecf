"""The training-data operators against brute force, on fixtures with nulls, ties, copies, clashing columns and no rows."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomelight.llm import embedding_dedup, exact_dedup, line_dedup, minhash_dedup, mixing, packing, sharding, site_trees, token_files, toxicity
from tomelight.llm._common import connected_components, scratch
from tomelight.llm._tokens import Encoder, default_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid int, size string, h double"


def rows_of(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t or ""), "clash", 7, "clash", 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "épée", "zeta", "eta", "theta", "iota", "kappa", "l'été", "mu", "nu", "x1", "42"]
    make = lambda n: " ".join(draw.choice(words) + (draw.choice([".\n", ",", ""]) if draw.random() < 0.2 else "") for _ in range(n))
    base = [make(draw.randint(1, 120)) for _ in range(30)]
    out = [*base, None, "", " \n\t ", "one", "Two words", base[0], base[0].upper(), base[1].replace(" ", "  "), base[2] + "\n", make(4000)]
    for b in base[3:12]:
        parts = b.split(" ")
        parts[draw.randrange(len(parts))] = "changed"
        out.append(" ".join(parts))
    passage = "\n".join(make(30).replace("\n", " ") for _ in range(3))
    out += [make(40) + "\n" + passage + "\n" + make(20), passage, make(10) + "\n\n" + passage + "\n\nend", passage + "\n" + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def smallest_reached(nodes, links):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {n: root(n) for n in nodes}


def library():
    """The library as it comes, apart from the encoder's own object."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_encoder_equals_the_library():
    encode, known, draw = Encoder(default_vocabulary(), 500), library(), random.Random(1)
    parts = [" ", "\n", "\t", "'s", "ab", "é", "12", "!", " ", " ", " w", "<|endoftext|>", "'ll", "'", "字", "\r\n", "\x1c", "\x85", "😀", "%%%", "  ", "\n\n", "\u00a0", "\u3000", "\u200b", "x\u0301"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(6000)]
    texts += ["".join(draw.choice(parts[:10]) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    wanted = [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encode(t), encode.dtype).tolist() for t in texts] == wanted
    for at in range(0, len(texts), 450):
        ids, bounds = encode.batch(pa.array([*texts[at : at + 450], None]), 7)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [*([*w, 7] for w in wanted[at : at + 450]), [7]]
    assert encode.batch(pa.array([], pa.string()), 7)[1].tolist() == [0]


def test_encoder_finds_added_tokens():
    encode, known = Encoder(default_vocabulary()), library()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  z", "<|endoftext", "one two\n<|endoftext|>"):
        wanted = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), encode.dtype).tolist() == wanted, repr(text)
        assert encode.batch(pa.array(["a", text]), 0)[0].tolist() == [64, 0, *wanted, 0]
    assert np.frombuffer(encode("a <|endoftext|> b"), encode.dtype).tolist() == [64, 220, 50256, 275]


def plain_ids(text, end, known=[]):  # noqa: B006
    if not known:
        known.append(library())
    return [*known[0].encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, empty, texts):
    for size in (64, 8 << 20):
        found = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(docs, scratch(spark), file_bytes=size)).collect()}
        start = 0
        for i, text in enumerate(texts):
            ids = plain_ids(text, 0)
            assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), crc(ids))
            start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(empty, scratch(spark))).count() == 0


def test_token_files_null_repeated_and_wide_ids(spark):
    rows = [(None, "a"), (5, "b"), (5, "b"), (-(2**63), "c"), (2**63 - 1, None)]
    found = token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark))).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -(2**63), 5, 5, 2**63 - 1]
    # a third of all rows without doc_id, half of these of one text, stays in order and is spread over files
    rows = [(None, f"t{i // 2}" if i % 2 else "same") for i in range(200)] + [(i, f"own {i}") for i in range(400)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch(spark))
    found = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 200 + list(range(400)) and sorted(r.ids_crc32 for r in found) == sorted(crc(plain_ids(t, 0)) for _, t in rows)
    assert max(r.documents for r in manifest.collect()) < 300
    data = token_files.pack_file([None, 3, 3, 9], [b"\1\0", b"\2\0\3\0", b"", b"\4\0"], 2)
    file = token_files.TokenFile(data)
    assert file.doc_ids() == [None, 3, 3, 9] and file.document(1).tolist() == [2, 3] and file.document(3).tolist() == [4]


def test_elias_fano_selects_any_index():
    draw = np.random.default_rng(3)
    for n, top in ((1, 1), (7, 3), (1000, 10), (5000, 1 << 40)):
        values = np.sort(draw.integers(0, top, n))
        packed = token_files.EliasFano.unpack(token_files.EliasFano.of(values).pack())
        index = draw.integers(0, n, 200)
        assert (packed.select(index) == values[index]).all()


def test_packing_covers_every_id_once(docs, empty, texts):
    for window, shard in ((64, 500), (2048, 1_500_000)):
        pieces = packing.pack(docs, window=window, shard_tokens=shard).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        assert set(by_doc) == set(range(len(texts)))
        for i, own in by_doc.items():
            ids, at = plain_ids(texts[i], 1), 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length]) and p.doc_tokens == len(ids)
                at += p.length
            assert at == len(ids)
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == window or (at & (at - 1)) == 0
    assert packing.pack(empty).count() == 0


def test_packing_prefers_lexical_neighbours():
    vocabulary = 50
    arrays = [np.array(a, np.uint16) for a in ([1, 2, 3], [9, 10, 11], [1, 2, 4], [9, 10, 12])]
    windows = list(packing._pieces(arrays, np.ones(vocabulary), 3.0, 6))
    assert [[p[0] for p in w] for w in windows] == [[0, 2], [1, 3]]


def test_packing_scores_whole_documents(spark):
    # each long document's first window has words of its own, its rest only words that all have; one short document has the former
    draw = random.Random(8)
    common = "time year people way day man thing woman life child".split()
    own = [[f"{a}{b}" for b in ("zeb", "quag", "lyn", "yak")] for a in ("ka", "mo", "ru", "se", "ti", "vo")]
    filler = lambda n: " ".join(draw.choice(common) for _ in range(n))
    long_ones = [(i, " ".join(w * 12) + " " + filler(40)) for i, w in enumerate(own)]
    partners = [(100 + i, " ".join(w)) for i, w in enumerate(own)]
    others = [(200 + i, filler(12)) for i in range(60)]
    docs = spark.createDataFrame(long_ones + partners + others, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = packing.pack(docs, window=64).collect()
        keys = {r.doc_id: r.key for r in packing._encode(docs, default_vocabulary(), 1, 64).where("doc_id is not null").collect()}
        same = spark.createDataFrame([(0, " zeta eta" * 40 + " mu"), (1, " zeta eta mu")], "doc_id long, text string")
        same = [r.key for r in packing._encode(same, default_vocabulary(), 1, 64).where("doc_id is not null").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(keys) == 72 and same[0] == same[1]
    places = collections.defaultdict(set)
    for r in rows:
        places[r.doc_id].add(r.sequence_id)
    assert [bool(places[i] & places[100 + i]) for i in range(6)] == [True] * 6


def test_exact_dedup(spark, docs, empty, texts):
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(texts)}
    for block in (3, 1024):
        found = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, block_chars=block).collect()}
        for i in plain:
            group = [j for j in plain if plain[j] == plain[i]]
            keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
            assert (found[i].keep_id, found[i].group_size, found[i].kept) == (keep, len(group), keep == i)
    assert exact_dedup.exact_dedup(empty).count() == 0
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "c")], "doc_id long, text string")
    assert sorted(r.group_size for r in exact_dedup.exact_dedup(repeated).where("kept").collect()) == [1, 3]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(repeated).collect()) == [1, 2]


def test_exact_dedup_of_blocks(spark):
    """Texts of many blocks with common parts, characters of several units, and one that is long."""
    draw = random.Random(3)
    parts = ["ab", "é字", "😀x", "abab"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(300)] + ["ab" * 600_000, "ab" * 600_000 + "a", "ab " * 600_000]
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).where("doc_id < 300").collect()}
    plain = [t.replace(" ", "") for t in texts]
    size = collections.Counter(plain[:300])
    assert {i: r.group_size for i, r in found.items()} == {i: size[plain[i]] for i in range(300)}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("doc_id >= 300").collect()}
    assert found == {300: (302, 2, False), 301: (301, 1, True), 302: (302, 2, True)}


def test_clashing_names_stay_as_they_are(spark):
    names = "gone", "k", "s", "p", "own_id", "own_sha", "own_points", "row", "row_number", "taken_spans", "stays", "rid", "_id", "_rid", "a.b"
    rows = [(i, t, None if i == 2 else "s", len(t or ""), *(f"{n}{i}" for n in names)) for i, t in enumerate(["one two", "one  two", "three four five six seven eight", None, "nine"])]
    schema = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    model = toxicity.Model(b"", b"")
    for stage in (exact_dedup.drop_exact_copies, minhash_dedup.drop_near_copies, mixing.mixed_documents, lambda d: toxicity.keep_clean(d, model)):
        out = stage(docs)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], stage
            assert r.n_chars == len(r.text or "")
        assert stage(docs.limit(0)).count() == 0
    twins = spark.createDataFrame([(1, "a b"), (1, "ab "), (1, " ab"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact_copies(twins).collect()) == [(0, "c"), (1, " ab")]


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_links(sets):
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_minhash_components(docs, empty, texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    wanted = smallest_reached(sets, near_links(sets))
    found = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: (found[i].n_shingles, found[i].component_id, found[i].kept) for i in sets} == {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in sets}
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_minhash_group_of_copies_of_copies(spark):
    """Copies edited apart from each other, chains, and a passage that many texts share."""
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(10**6)}"
    base = [word() for _ in range(150)]
    out = []
    for _ in range(60):
        own = list(base)
        for _ in range(draw.randint(1, 5)):
            own[draw.randrange(len(own))] = word()
        out.append(" ".join(own))
    chain = list(base[::-1])
    for _ in range(25):
        chain[draw.randrange(len(chain))] = word()
        out.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    out += [" ".join([*(word() for _ in range(80)), *passage]) for _ in range(40)]
    sets = {i: shingle_set(t) for i, t in enumerate(out)}
    wanted = smallest_reached(sets, near_links(sets))
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows_of(out), SCHEMA)).collect()}
    assert found == wanted


def test_mixing_meets_targets(docs, empty, texts):
    documents, slots = mixing.mix(docs, block=8)
    found = {r.rid: r.asDict() for r in documents.collect()}
    taken = collections.Counter()
    for r in mixing.taken_pieces(documents, slots, 8).collect():
        taken[r.rid] += r.words
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by_source = collections.defaultdict(list)
    for rid, r in found.items():
        assert r["size"] == size[r["doc_id"]] and taken[rid] <= 3 * r["size"]
        by_source[r["source"]].append(rid)
    total = sum(size.values())
    shares = dict(zip(sorted(by_source), (5, 2, 1), strict=True))
    targets, sizes = {}, {s: sum(found[r]["size"] for r in own) for s, own in by_source.items()}
    left, open_ = float(total), set(shares)
    while open_:
        level = left / sum(shares[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * shares[s]}
        for s in full or open_:
            targets[s] = 3.0 * sizes[s] if full else level * shares[s]
            left -= targets[s]
        open_ -= full or set(open_)
    for s, own in by_source.items():
        assert found[own[0]]["target"] == pytest.approx(targets[s])
        assert sum(taken[r] for r in own) == int(targets[s] + 1e-6)
    assert mixing.mix(empty)[0].count() == 0


def test_mixing_parts():
    for n in (1, 2, 5, 64, 1000):
        out = mixing.permute(np.arange(n), n, 17)
        assert sorted(out.tolist()) == list(range(n))
        assert (mixing.permute(out, n, 17, inverse=True) == np.arange(n)).all()
    totals = np.array([1000, 400, 3, 0])
    counts = [mixing.shard_counts(totals, 100, s) for s in range(15)]
    assert (sum(counts) == totals).all() and all(c.sum() == 100 for c in counts[:14])
    assert mixing.cut_words("a  b\nc d", [(0, 4)]) == "a  b\nc d"
    assert mixing.cut_words("a  b\nc d", [(0, 1), (1, 1), (3, 1)]) == "a  b\nd"


def test_mixed_documents_keep_columns(docs, texts):
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    words = collections.Counter()
    for r in rows:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    assert all(n <= 3 * len(WORD.findall(texts[i])) for i, n in words.items())


def naive_ring(rows, shards, virtual):
    """Shard of each row (doc_id, text) by walking the ring one row at a time, home arcs first."""
    nodes = sharding.ring(shards, virtual)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = collections.defaultdict(list)
    for number, (place, doc_id, check) in enumerate(rows):
        arc = next((a for a, (at, _) in enumerate(nodes) if at >= place), 0)
        arcs[arc].append((doc_id is not None, doc_id or 0, check, number))
    load, beyond = collections.Counter(), collections.Counter()
    for arc, (_, shard) in enumerate(nodes):
        kept = min(len(arcs[arc]), room[shard] - load[shard])
        load[shard] += kept
        beyond[arc] = len(arcs[arc]) - kept
    return nodes, arcs, room, beyond


def test_sharding_is_even_and_follows_the_ring(spark, docs, empty, texts):
    found = sharding.shard_documents(docs, shards=5, virtual=8, bucket_rows=2).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    places = {r.doc_id: r.p for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("p")).collect()}
    nodes, arcs, room, beyond = naive_ring([(places[i], i, 0) for i in range(len(texts))], 5, 8)
    shard_of = {r.doc_id: r.shard for r in found}
    for arc, own in arcs.items():
        moved = [i for _, i, _, _ in own if shard_of[i] != nodes[arc][1]]
        assert len(moved) <= beyond[arc]
    # a row at a time: home arcs in ring order, then what is left over goes clockwise to the next shard with room
    left, wanted = list(room), collections.Counter()
    for turn in (0, 1):
        for arc in range(len(nodes)):
            for k in range(len(arcs[arc])):
                home = nodes[arc][1]
                if turn == 0 and k < len(arcs[arc]) - beyond[arc]:
                    left[home] -= 1
                    wanted[arc, home] += 1
                elif turn == 1 and k >= len(arcs[arc]) - beyond[arc]:
                    at = arc
                    while not left[nodes[at % len(nodes)][1]]:
                        at += 1
                    left[nodes[at % len(nodes)][1]] -= 1
                    wanted[arc, nodes[at % len(nodes)][1]] += 1
    home_of = {i: arc for arc, own in arcs.items() for _, i, _, _ in own}
    assert collections.Counter((home_of[r.doc_id], r.shard) for r in found) == wanted and not any(left)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values())) == sorted(room)
    assert sharding.shard_documents(empty).count() == 0
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(2), shards=5, virtual=8, bucket_rows=2).collect()}
    assert {i: s for i, (s, _) in again.items()} == shard_of


def test_sharding_spreads_a_hot_arc(spark):
    rows = [(None, f"t{i}" if i % 2 else "same") for i in range(400)] + [(5, "x")] * 200 + [(i, f"own{i}") for i in range(600)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=24, virtual=8, bucket_rows=10).collect()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == 1200 and all(sorted(s) == list(range(50)) for s in slots.values()) and len(slots) == 24


def test_ring_walk_moves_only_overflow():
    nodes = sharding.ring(4, 32)
    draw = random.Random(2)
    counts = {arc: draw.randrange(20) for arc in range(len(nodes))}
    plan = sharding.walk(nodes, counts, 4)
    total = sum(counts.values())
    load = collections.Counter()
    for _arc, first, last, shard, _ in plan:
        load[shard] += last - first
    assert sum(load.values()) == total and max(load.values()) - min(load.values()) <= 1
    home = collections.Counter()
    for arc, n in counts.items():
        home[nodes[arc][1]] += n
    stayed = sum(last - first for arc, first, last, shard, _ in plan if nodes[arc][1] == shard)
    assert stayed >= sum(min(home[s], load[s]) for s in range(4))


def deleted_lines(texts, order, least=50):
    """By brute force: every line of a run of ``least`` words or more that stands earlier, in the order of documents."""
    lines = {}
    for i, text in texts.items():
        split = [(k, tuple(WORD.findall(x.translate(LOWER)))) for k, x in enumerate((text or "").split("\n"))]
        lines[i] = [x for x in split if x[1]]
    seen, gone = {}, collections.defaultdict(set)
    for i in order:
        own = lines[i]
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(len(x[1]) for x in own[a : b + 1]) >= least:
                    key = tuple(x[1] for x in own[a : b + 1])
                    if key not in seen:
                        seen[key] = (i, b)
                    else:
                        start = max(a, seen[key][1] + 1) if seen[key][0] == i else a
                        gone[i].update(x[0] for x in own[start : b + 1])
    return gone


def check_lines(found, texts, gone):
    for r in found:
        split = (texts[r.doc_id] or "").split("\n")
        assert {k for s in r.spans for k in range(s.low, s.high + 1) if split[k].strip()} == gone[r.doc_id], r.doc_id
        assert r.n_deleted == sum(s.high - s.low + 1 for s in r.spans)
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())


def test_line_runs_are_deleted_once(docs, empty, texts):
    gone = deleted_lines(dict(enumerate(texts)), range(len(texts)))
    assert any(gone.values())
    check_lines(line_dedup.dedup_lines(docs).collect(), texts, gone)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_of_few_lines_in_many_orders(spark):
    """Texts made of few different lines: runs overlap, repeat inside a text, and have many partners."""
    draw = random.Random(31)
    pool = [" ".join(f"{c}{i}" for i in range(draw.choice([1, 2, 5, 9]))) for c in "abcd"]
    texts = ["\n".join(draw.choice([*pool, ""]) for _ in range(draw.randint(0, 25))) for _ in range(60)]
    texts += ["\n".join([pool[0]] * 30), None, texts[3]]
    gone = deleted_lines(dict(enumerate(texts)), range(len(texts)), 12)
    assert sum(map(len, gone.values())) > 200
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_lines(line_dedup.dedup_lines(rows, 12).collect(), texts, gone)


def test_line_runs_of_repeated_rows_and_null_ids(spark):
    passage = "\n".join(" ".join(f"{c}{i}" for i in range(20)) for c in "xyz")
    rows = [(None, passage + "\nfirst"), (None, passage + "\nfirst"), (4, "own\n" + passage), (4, "own\n" + passage), (9, None)]
    found = sorted((r.doc_id or 0, r.text or "", r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, passage + "\nfirst", 0)] * 2 + [(4, "own", 3)] * 2 + [(9, "", 0)]


def vector_truth(x, threshold=0.9):
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    return list(zip(i.tolist(), j.tolist(), strict=True))


def test_near_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((40, 16))
    near = base[:10] + draw.standard_normal((10, 16)) * 0.08
    x = np.concatenate([base, near, base[:3], base[3:5] * 2.5]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2, "clash", "clash") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    rows += [(n + 7, [0.0, 1.0, 2.0]), (n + 8, [-0.0, 1.0, 2.0]), (n + 9, [-0.0, 5.0, 1.0]), (n + 10, [9.0, 1.0, -0.0]), (n + 11, [float("-inf"), 1.0]), (n + 12, [-0.0, -0.0])]
    table = spark.createDataFrame([(*r[:2], 0, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, copies string, cid string")
    links = vector_truth(x) + [(n + 5, n + 6), (n + 7, n + 8)]
    wanted, degree = smallest_reached(range(n + 13), links), collections.Counter(k for link in links for k in link)
    for cell in (8, 4096):
        found = {r.vec_id: r for r in embedding_dedup.near_vectors(table, cell=cell, recall=0.9999).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (degree[i], wanted[i], wanted[i] == i) for i in range(n + 13)}
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [0.0, 3.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(repeated).collect())
    assert found == [(0, 1, 7, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (7, 1, 7, True)]


def test_near_vectors_dense_groups(spark, monkeypatch):
    """A third of all rows around one point (a core), a wider group that no core covers, parts of a full cell."""
    draw = np.random.default_rng(12)
    centre, wide = draw.standard_normal(24), draw.standard_normal(24)
    x = np.concatenate([centre + draw.standard_normal((150, 24)) * 0.12, wide + draw.standard_normal((150, 24)) * 0.33, draw.standard_normal((150, 24))])
    x = x[draw.permutation(len(x))]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    links = vector_truth(x)
    wanted, degree = smallest_reached(range(len(x)), links), collections.Counter(k for link in links for k in link)
    for cell, block, least in ((4096, 64, 8), (32, 64, 8), (32, 64, 10**9)):
        monkeypatch.setattr(embedding_dedup, "HUB_LEAST", least)
        found = {r.vec_id: r for r in embedding_dedup.near_vectors(table, cell=cell, block=block, recall=0.9999).collect()}
        assert sum(abs(found[i].n_links - degree[i]) for i in found) <= 0.001 * 2 * len(links)
        assert {i: r.component_id for i, r in found.items()} == wanted


def test_near_vectors_recall_at_the_threshold(spark):
    """Recall of pairs at cosines 0.9 to 0.95, 64 dimensions, with tables as a larger corpus has them."""
    draw, n = np.random.default_rng(6), 8000
    a = draw.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.standard_normal((n, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = np.where(np.arange(n) < n // 2, 0.9 + 1e-9, 0.92)[:, None]
    pairs = np.stack([a, cosine * a + np.sqrt(1 - cosine**2) * b], 1).reshape(-1, 64)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(pairs.tolist())], "vec_id long, embedding array<double>")
    for cell in (128, 1024):
        found = embedding_dedup.near_vectors(table, cell=cell).where("n_links > 0").groupBy((F.col("vec_id") < n).alias("at")).count()
        found = {r["at"]: r["count"] / n for r in found.collect()}
        print("recall at 0.9, 0.92, cell", cell, found[True], found[False])
        assert 0.99 <= found[True] <= 1 and 0.998 <= found[False] <= 1


def page(article, extra=""):
    return f'<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href="/x">Home</a></nav>{article}{extra}<footer>&copy; foot</footer></body></html>'


def test_main_text(spark):
    article = "<article><h1>Title &amp; more</h1><p><b>Lead.<br><p>One\n  two&nbsp;three</p><script>var t='</p>';</script><ul><li>a<li>b</ul><div class='share-buttons'>Share</div><section class=comments><p>nice</p></section></article>"
    rows = [(1, "http://a.example/1", page(article)), (2, None, None), (3, "http://a.example/2", ""), (4, "http://a.example/3", page("<div class='content'><p>Only text</p></div>", "<aside>side</aside><div id='cookie-notice'>ok</div><form>f</form>"))]
    rows += [(10 + i, f"http://b.example/{i}", page(f"<div class='body'><p>Story number {i} is its own.</p></div><div class='x'><p>Read this on every page</p></div>")) for i in range(12)]
    found = {r.page_id: r for r in site_trees.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Title & more\nLead.\nOne two three\na\nb"
    assert (found[2].text, found[2].n_chars, found[3].text) == ("", 0, "")
    assert found[4].text == "Only text"
    assert all(found[10 + i].text == f"Story number {i} is its own." for i in range(12))
    assert site_trees.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def naive_importance(pages):
    """node key -> importance in the style tree of one host, from its definition."""
    read = {}
    for html in pages:
        page = site_trees.Page(html)
        read.setdefault(page.main(page.blocks), page)
    styles, texts, chains = collections.defaultdict(list), collections.defaultdict(collections.Counter), {}
    for page in read.values():
        children, path_of = collections.defaultdict(list), {}
        shown = [e for e in page.elements if e.tag not in site_trees.UNSEEN]
        for e in shown:
            chains[e.path] = [*(chains[e.parent.path] if e.parent is not None else []), e.path]
            path_of[e.number] = e.path
            if e.parent is not None and (not children[e.parent.path] or children[e.parent.path][-1] != e.tag):
                children[e.parent.path].append(e.tag)
        for path in {e.path for e in shown}:
            styles[path].append(tuple(children[path]))
        for text, path in {(t, path_of[n]) for t, n in page.blocks}:
            texts[path][text] += 1
    out = {}
    for branch in styles:
        p = q = m = n = 0.0
        for path in (x for x in styles if branch in chains[x]):
            pages = len(styles[path])
            shares = [c / pages for c in collections.Counter(styles[path]).values()]
            p += pages * (-sum(s * np.log(s) for s in shares) / np.log(pages) if pages > 1 else 0)
            q += sum(1 - (np.log(c) / np.log(pages) if pages > 1 else 0) for c in texts[path].values())
            m, n = m + pages, n + len(texts[path])
        if n:
            composite = (1 - site_trees.GAMMA) * p / m + site_trees.GAMMA * q / n
            out[branch] = (len(styles[branch]) * composite + site_trees.PRIOR) / (len(styles[branch]) + site_trees.PRIOR)
    return out


def test_long_and_deep_pages_are_read_in_linear_time():
    pages = ["<a " * 350_000, '<a x="' * 170_000, "<div>" * 200_000, "<div>" * 200_000 + "x" + "</div>" * 200_000, "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "<div></div>" * 100_000]
    pages += ["<div>" * 100_000 + "</x>" * 100_000, "<b>t " * 200_000, "<header>h" * 100_000, "<article class=x>h" * 60_000, "<script>" + "</script " * 100_000, "<!-- " * 200_000, "<! " * 300_000, "&" * 1_000_000]
    began = time.time()
    for html in pages:
        page = site_trees.Page(html)
        page.main(page.blocks)
        assert len(page.tree()) <= 8 + 24 * len(page.elements) + 16 * len(page.blocks)
    assert time.time() - began < 120  # a few seconds a page on a slow machine; by the square it would be hours


def test_deep_trees_are_summed_whole(spark, monkeypatch):
    draw = random.Random(3)
    pages = [nameless(i, draw).replace("<body>", "<body>" + "<i class=d>" * 9 + "<u>" * (i % 3)) for i in range(20)]
    table = spark.createDataFrame([(i, "http://a.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(2)
    wanted = naive_importance(pages)
    monkeypatch.setattr(site_trees, "CHAIN", 3)
    for source in (site_trees,):
        found = {r.node: r.importance for r in source.branches(table).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_names_of_what_readers_and_blogs_add(spark):
    html = "<article><h1>T</h1><p>Main text of it.</p><section id='responses'><p>reply</p></section><ul class=tags><li>a tag</ul></article><div class='blog-roll'><p>other blogs</p></div>"
    table = spark.createDataFrame([(1, None, html), (1, None, html)], "page_id long, url string, html string")
    assert [r.text for r in site_trees.main_text(table).collect()] == ["T\nMain text of it."] * 2


def nameless(i, draw):
    """A page whose template parts have no telling tag, class or id."""
    story = "".join(f"<p>Sentence {draw.random()} of story {i}.</p>" for _ in range(draw.randint(1, 5)))
    offers = draw.choice(["Buy one", "Buy two"])
    return f"<html><body><div class='xa'><div>Home</div><div>Archive</div></div><div class='xb'><h1>Story {i}</h1>{story}<div class='y'>Read this on every page</div></div><div class='xc'><p>{offers}</p></div><div>All rights reserved</div></body></html>"


def test_site_tree_alone_removes_nameless_templates(spark):
    draw = random.Random(2)
    pages = [nameless(i, draw) for i in range(40)]
    rows = [(i, "http://a.example/x", h) for i, h in enumerate(pages)] + [(90 + i, f"http://b.example/{i}", h) for i, h in enumerate(pages[:3])] + [(99, "http://a.example/copy", pages[0])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.node: r.importance for r in site_trees.branches(table).where("host = 'a.example'").collect()}
    wanted = naive_importance(pages)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    for marks in (False, True):
        texts = {r.page_id: r.text for r in site_trees.main_text(table, marks).collect()}
        for i in range(40):
            assert texts[i] == "\n".join([f"Story {i}", *re.findall("<p>(Sentence .*?)</p>", pages[i])])
        assert texts[99] == texts[0]
        # three pages are too few to tell
        assert all(texts[90 + i].startswith("Home\nArchive\nStory") for i in range(3))


def test_classes_that_wrap_the_main_part_stay(spark):
    one = "<body class='has-sidebar'><form id=aspnetForm><div class='content widget'><h1>Top</h1><p>Long text of the page.</p><p>More of it.</p></div></form><div class=sidebar>S</div></body>"
    two = "<body><div class='post category-social-media'><p>Kept</p></div><div class='comments-area'><article><p>A reader says much more than the page itself does</p></article></div></body>"
    three = "<body><article><p>Short</p></article><div><p>What is outside of the article is longer</p></div></body>"
    four = "<body><p>Text <button>Press</button><span hidden>no</span> goes on<!-- x --></p><div aria-hidden=true>h</div><div style='display: none'>h</div><div role=banner>b</div><header>h</header></body>"
    rows = [(i, None, h) for i, h in enumerate((one, two, three, four, "<p>" + "x &lt; y " * 200_000 + "</p>", "<nav>only</nav>", "&amp;", "<div", "<div class=widget><p>All there is</p></div><nav>n</nav>"))]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, nodes string")
    found = {r.page_id: r.text for r in site_trees.main_text(table).collect()}
    assert found[0] == "Top\nLong text of the page.\nMore of it." and found[1] == "Kept" and found[2] == "Short\nWhat is outside of the article is longer"
    assert found[3] == "Text goes on" and found[4] == ("x < y " * 200_000).strip() and found[5] == "" and found[6] == "&" and found[7] == "<div" and found[8] == "All there is"


def test_toxicity_holds_out_and_learns(spark):
    draw = random.Random(8)
    syllables = ["an", "er", "th", "on", "re", "sh", "ble", "ing"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    bad = ["zorgface", "plimwit", "kruddle", "vexhead"]
    texts, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(draw.randint(20, 150))], i % 4 == 0
        for _ in range(draw.randint(2, 5) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts += [None, ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(found[i].predicted == labels[i][2] for i in held)
    assert right / len(held) > 0.95
    assert len(found) == len(texts) and 0 <= found[900].score <= 1 and found[900].score == found[901].score
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in found.items() if r.predicted == 0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    flags = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("f")).collect()}
    assert [i for i in range(900) if flags[i]] == held


def test_toxicity_samples_are_bounded(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["an", "er", "th", "on", "re", "sh", "ble", "ing"]) * draw.randint(1, 3)
    long_one = " ".join(word() for _ in range(200_000))
    assert len(toxicity.some_windows(long_one)) == toxicity.ROW_WINDOWS and toxicity.some_windows("a b") == [b"a b"] and not toxicity.some_windows("")
    rows = [(i, long_one if i < 4 else None if i == 5 else " ".join(word() for _ in range(30)) + (" zorgface plimwit" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows * 2 + [(None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] * 2 + [(None, 1), (7, None), (9, 3)], "doc_id long, toxic int")
    sample, drawn = toxicity.sample_rows(docs, known, 100)
    found = sample.collect()
    assert len({r.doc_id for r in found}) == len(found) <= 100 and not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert drawn[0] < 1 == drawn[1]
    assert toxicity.score(docs, toxicity.train(docs, known)).count() == 401
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, known.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.train(docs.limit(0), known).curve is None


def test_toxicity_threshold_holds_for_a_bounded_sample(spark):
    # one of ten rows is toxic, half of these without a telling word; the bounded sample has as many toxic as ordinary rows
    draw = random.Random(9)
    syllables = ["an", "er", "th", "on", "re", "sh", "ble", "ing"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    texts, labels = [], []
    for i in range(2400):
        words = [word() for _ in range(draw.randint(20, 60))]
        for _ in range(4 if i % 20 == 0 else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["zorgface", "plimwit", "kruddle", "vexhead"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known, 240)).collect()}
    assert 0.05 < sum(r.score for r in found.values()) / 2400 < 0.15
    assert sum(found[i].predicted for i in range(2400) if i % 10) / 2160 < 0.05
    assert sum(found[i].predicted for i in range(0, 2400, 20)) / 120 > 0.9


def test_toxicity_windows_are_bounded(spark):
    for text in ("字" * 5000, "x" + "é" * 4000, "😀" * 3000, "a" * 10_000 + " b", "one\u00a0word" * 2000, "plain words " * 500, "x" * 161):
        data, cuts = toxicity.windows(text)
        assert b"".join(data[a : a + n] for a, n in cuts.tolist()) == text.encode() and 0 < cuts[:, 1].min() and cuts[:, 1].max() < 240
        assert [data[a : a + n].decode() for a, n in cuts.tolist()]
    draw = random.Random(8)
    syllables = ["an", "er", "th", "on", "re", "sh", "ble", "ing"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    bad = ["zorgface", "plimwit", "kruddle", "vexhead"]
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(draw.randint(20, 150))]
        for _ in range(draw.randint(2, 5) if i % 4 == 0 else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows_of(texts), SCHEMA), known)
    # no space for some 200 KB; every 40th word of the toxic text is telling
    clean = "\u00a0".join(word() for _ in range(30_000))
    toxic = "\u00a0".join(draw.choice(bad) if i % 40 == 0 else word() for i in range(30_000))
    low, high = model.scores([clean, toxic])
    assert low < toxicity.THRESHOLD <= high
    assert (model.gains(*toxicity.windows(toxic)) >= 2).sum() > 300


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_edges_of_every_operator_on_documents(spark):
    """Null doc_ids, null texts and sources, repeated rows, a very long text, extra columns: each operator gives one row a row."""
    draw = random.Random(77)
    word = lambda: draw.choice("alpha beta gamma delta épée zeta eta theta 42".split())
    long_one = "\n".join(" ".join(word() for _ in range(20)) for _ in range(6000))
    some = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(draw.randint(0, 9)))) for i in range(60)]
    rows = [*some, *some[:9], *some[:3], (None, None), (None, None), (None, "lonely words"), (77, None), (78, ""), (79, long_one), (None, long_one), (80, long_one + " more"), (-5, "x")]
    docs = spark.createDataFrame([(i, t, "en", None if n % 4 == 0 else f"s{n % 3}", 0, "clash", 7, "clash", 0.5) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    n = len(rows)

    found = minhash_dedup.near_duplicates(docs).collect()
    shingles = collections.Counter((r.doc_id, r.n_shingles) for r in found)
    assert len(found) == n and shingles == collections.Counter((i, len(shingle_set(t))) for i, t in rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[79].component_id == by_id[80].component_id == 79 and by_id[77].component_id == 77 and by_id[77].kept and by_id[-5].kept

    found = exact_dedup.exact_dedup(docs).collect()
    sizes = collections.Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows)
    assert len(found) == n and sum(r.kept for r in found) == len(sizes) and sorted(r.group_size for r in found if r.kept) == sorted(sizes.values())

    documents, slots = mixing.mix(docs, block=16)
    documents = documents.collect()
    assert len(documents) == n and collections.Counter(r["size"] for r in documents) == collections.Counter(len(WORD.findall(t or "")) for _, t in rows)
    total = sum(r["size"] for r in documents)
    targets = {r.source: r.target for r in documents}
    # by code point, null last: weights 5, 2, 1 and 5 again
    assert set(targets) == {"s0", "s1", "s2", None} and sum(targets.values()) == pytest.approx(total)

    found = sharding.shard_documents(docs, shards=7, virtual=4, bucket_rows=5).collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in found) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert max(collections.Counter(r.shard for r in found).values()) == -(-n // 7)

    pieces = packing.pack(docs, window=256).collect()
    wanted = collections.Counter({(i, len(plain_ids(t, 1))): 0 for i, t in rows})
    for i, t in rows:
        wanted[i, len(plain_ids(t, 1))] += len(plain_ids(t, 1))
    taken = collections.Counter()
    for p in pieces:
        taken[p.doc_id, p.doc_tokens] += p.length
    assert taken == wanted

    found = token_files.read_token_files(token_files.write_token_files(docs, scratch(spark))).orderBy("start").collect()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == sorted((i is not None, i or 0) for i, _ in rows)
    assert collections.Counter(r.ids_crc32 for r in found) == collections.Counter(crc(plain_ids(t, 0)) for _, t in rows)

    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == n and {r.doc_id: r.n_deleted for r in found}[80] == 5999 and all(r.text is None for r in found if r.doc_id == 77)

    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id in (77, 78)}) == 1


def naive_bm25(arrays, seed, weights, mean):
    """Score of every array for the distinct ids of one of them, from the formula."""
    scores = []
    for a in arrays:
        counts = collections.Counter(a.tolist())
        score = 0.0
        for term in set(arrays[seed].tolist()):
            tf = counts[term]
            score += weights[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(a) / mean)) if tf else 0
        scores.append(score)
    return scores


def test_packing_takes_the_best_neighbours():
    """Windows of one shard against a plain loop: the best unused neighbour by BM25, then key order."""
    draw = np.random.default_rng(14)
    arrays = [draw.zipf(1.6, draw.integers(3, 30)).clip(1, 199).astype(np.uint16) for _ in range(120)]
    frequency = np.bincount(np.concatenate([np.unique(a) for a in arrays]), minlength=200)
    weights = np.maximum(0, np.log((120 - frequency + 0.5) / (frequency + 0.5))) * (frequency > 0)
    mean = float(np.mean([len(a) for a in arrays]))
    used, wanted, left, at = set(), [], None, 0
    while left is not None or len(used) < len(arrays):
        if left is None:
            left, at = min(set(range(120)) - used), 0
            used.add(left)
        seed, room, own = left, 64, []
        scores = naive_bm25(arrays, seed, weights, mean)
        while True:
            take = min(room, len(arrays[left]) - at)
            own.append((left, at, take))
            room, at = room - take, at + take
            left = None if at == len(arrays[left]) else left
            if not room or left is None and len(used) == len(arrays):
                break
            open_ = [i for i in range(120) if i not in used]
            left = min(open_, key=lambda i: (-round(scores[i], 9), i))
            used.add(left)
            at = 0
        wanted.append(own)
    assert list(packing._pieces(arrays, weights, mean, 64)) == wanted
