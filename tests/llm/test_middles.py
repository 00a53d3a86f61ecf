"""Fill-in-middle by the skip list, against cutting lists of lines."""

import random
import re
from hashlib import sha256

import pytest

from tomelight.llm import fill_in_middle as fim
from tomelight.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, form string, n int, output string"


def plain_cut(doc_id, text):
    """(n, form, output, prefix code points, middle code points) by lists of lines."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", text, None, None
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(lines), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    line = lambda: "".join(draw.choice(["a", "é", "漢", "😀", " ", "\r", "<", "P>", "\x0b", "\x85"]) for _ in range(draw.randrange(12)))
    out = [None, "", "\n", "\n" * 5000, "one", "one\n", "two\n\nlines", "has <P> in it\nb", "<S>", "x<M>", "<P\n>S>", "<\n<S\n<M", "é" * 3000, "long\n" * 40000]
    return out + ["\n".join(line() for _ in range(draw.choice([1, 2, 31, 32, 33, 200, 1100]))) + draw.choice(["", "\n"]) for _ in range(60)]


def test_list_reaches_every_rank(texts):
    for fan, size in ((2, 7), (3, 16), (32, 1 << 20)):
        for text in texts[:14] + texts[14:30]:
            text = (text or "")[:3000]
            lines = re.findall(r"[^\n]*\n|[^\n]+", text)
            found = fim.Lines(text.encode(), fan, size)
            assert (found.n, found.chars) == (len(lines), len(text))
            for rank in {0, 1, len(lines) // 3, len(lines) // 2, max(0, len(lines) - 1), len(lines)} & set(range(len(lines) + 1)):
                before = "".join(lines[:rank])
                assert found.before(rank) == (len(before), len(before.encode()))


def test_lanes_carry_widths():
    found = fim.Lines(b"ab\n" * 1000, fan=4)
    assert [len(lane) for lane in found.lanes] == [250, 63, 16, 4]
    assert all(lane.sum(0).tolist() == [1000, 3000, 3000] for lane in found.lanes)


def test_output_and_restored(spark, texts):
    rows = [(i if t is not None else None, t, "clash", 7, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash", 7, "clash")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = fim.fill_in_middle(docs)
    found = sorted(out.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    wanted = sorted(((i, *plain_cut(i, t or "")) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0]))
    assert [tuple(r) for r in found] == wanted
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    back = {r.doc_id: r.text for r in fim.restore(out).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"a\nb{i}\n", "", 0, "") for i in range(2000)], SCHEMA)
    counts = {r["form"]: r["count"] for r in fim.fill_in_middle(docs, rate=30, spm_rate=90).groupBy("form").count().collect()}
    assert 1300 < counts["plain"] < 1500 and counts["spm"] > 5 * counts["psm"] > 0
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_has_sql():
    assert "op12_line_middles" in ORACLES
