"""BPE by tree concatenation, against the library on whole texts."""

import random
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tomelight.llm import tree_bpe
from tomelight.llm.tree_bpe import Part, WordBPE, default_vocabulary

ATOMS = ["a", "b", "e", "th", "ing", "A", "É", "é", "=", "-", "'", "'s", "'ll", "<", "|", "<|endoftext|>", "<|startoftext|>", "1", "23", " ", "\n", "漢", "字", "か", "が", "가"]
ATOMS += ["İ", "ß", "Σ", "ς", "́", " ", "​", "\x85", "\x1c", "😀", "ﬁ", "ي", "ab" * 5, "===" * 3, "un", "ion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def coders():
    return [WordBPE(default_vocabulary(), leaf) for leaf in (16, 64, tree_bpe.LEAF)]


def whole(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(shown.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=150), st.integers(1, 5))
def test_tree_equals_the_library(library, coders, atoms, times):
    text = "".join(atoms) * times
    ids = library.encode(text, add_special_tokens=False).ids
    for own in coders:
        assert own.encode(text) == ids
    assert coders[-1].digests(text) == whole(library, text)
    assert coders[0].digests_of_ids(np.array(ids, "<u4"), 7) == whole(library, text)
    leaves = coders[0].leaves(text, 48)
    assert "".join(t for t, _, _ in leaves) == text
    assert not text or coders[0].tree([coders[1].part(*leaf) for leaf in leaves]).ids == ids


def test_long_unsplit_text(library, coders):
    draw = random.Random(2)
    for text in ("a" * 60_000, "".join(draw.choice("abcdefgh") for _ in range(60_000)), "漢字" * 20_000, "=-" * 20_000, "́" * 20_000, "x" * 5000 + " 'll" + "7" * 5000):
        assert coders[-1].encode(text) == library.encode(text, add_special_tokens=False).ids
        assert all(len(t) <= 3 * tree_bpe.LEAF for t, _, _ in coders[-1].leaves(text, tree_bpe.LEAF)) or text[0] == "́"


def test_windows_grow_until_sides_agree(library, coders):
    own = coders[-1]
    left, right = ([t.id for t in own.open.tokenize("aaa")], [t.id for t in own.closed.tokenize("aaaa")])
    joined = own.joined(Part(left, False, True, 0, len(left)), Part(right, True, False, len(right), 0))
    assert joined.ids == library.encode("aaaaaaa", add_special_tokens=False).ids


def test_documents(spark, library):
    draw = random.Random(4)
    long = "".join(draw.choice(ATOMS) for _ in range(3000))
    texts = [None, "", "  \n", " ", "Hello  World, it's 12 o'clock.", "<|endoftext|>", long, long, "q" * 4000, "word " * 900, "=" * 3000 + "'s", *("".join(draw.choice(ATOMS) for _ in range(50)) for _ in range(20))]
    rows = [(i % 25 if i else None, t, 1, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    key = lambda r: tuple((v is not None, v) for v in r)
    wanted = sorted(((i, *whole(library, t)) for i, t, *_ in rows), key=key)
    for longest, span, fan in ((tree_bpe.LONG, tree_bpe.SPAN, tree_bpe.FAN), (400, 128, 2), (0, 100, 3)):
        assert sorted(map(tuple, tree_bpe.encoded_digests(docs, None, longest, span, fan).collect()), key=key) == wanted
        ids = tree_bpe.encode(docs, None, longest, span, fan)
        assert sorted(map(key, ids.selectExpr("doc_id", "concat_ws(' ', ids) s").collect())) == sorted(key((i, " ".join(map(str, library.encode(t or "", add_special_tokens=False).ids)))) for i, t, *_ in rows)
    shown = sorted(map(key, tree_bpe.decode(tree_bpe.encode(docs)).collect()))
    assert shown == sorted(key((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False))) for i, t, *_ in rows)
    assert tree_bpe.encoded_digests(docs.limit(0)).count() == 0
