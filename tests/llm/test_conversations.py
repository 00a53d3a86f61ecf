"""Conversation repair against plain backward search over all edits."""

import itertools
import random
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from tomelight.llm import conversations as cv
from tomelight.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(SPACE)
        out.append("blank" if not shown.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_audit(rows):
    """(cost, audit) by trying every edit, from the end backwards."""
    found, new = plain_faults(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            c, x = best(i, new[state], inserted + 1)
            ways.append((c + 2, "I" + x))
        if i < len(rows):
            (role, _), cut = rows[i], found[i] == "truncated"
            c, x = best(i + 1, state, 0)
            ways.append((c + 3, "D" + x))
            if found[i] not in ("blank", "duplicate"):
                c, x = best(i + 1, new[state], 0)
                ways.append((c + 2 + cut, "R" + x))
                if (state, role[:1]) in allowed:
                    c, x = best(i + 1, role[:1], 0)
                    ways.append((c + cut, "K" + x))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def plain(conversations):
    """conv_id -> the columns of the query."""
    out, spaced = {}, lambda v: " " if v is None else v
    for conv_id, group in itertools.groupby(sorted(conversations, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        rows = []
        for _, turn, role, text, *_ in group:
            d, role, text = zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            rows += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        rows.sort()
        turns, rows = [r[1] for r in rows if r[0]], [r[2:] for r in rows]
        found, (cost, audit) = plain_faults(rows), plain_audit(tuple(rows))
        lines, state, at = [], "", 0
        for edit in audit:
            role, text = rows[at] if edit != "I" else ("", "")
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == "u" else "user"
                state = role[:1]
                lines.append(f"{role}:{text}")
        initials = [r[:1] for r, _ in rows]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv_id] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def drawn(seed, count, long=0):
    draw, out = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "User", "ua"]
    texts = ["Yes.", "No!", "so", "", " \n", "Why?", "well ", "Yes. ", None, "é.", "a\nb.", "漢"]
    for conv in range(count):
        turn = draw.choice([0, 1, -5])
        for _ in range(draw.randrange(9) if conv else long):
            turn += draw.choice([1, 1, 1, 2, 7])
            text = draw.choice(texts)
            out.append((conv or None, None if draw.random() < 0.03 else turn, draw.choice(roles), text if draw.random() < 0.4 or not text else f"{turn}{text}", "clash", 7))
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in cv.audits(cv.damaged(docs), **options).collect()}


def test_audits_compare_like_lists():
    draw = random.Random(1)
    for prime in (cv._PRIME, 5):  # with 5 most hashes collide and only the check of letters tells lists apart
        audits, lists = cv.Audits(prime), [[]]
        for _ in range(600):
            parent = draw.randrange(len(lists)) if draw.random() < 0.3 else len(lists) - 1
            letter = draw.randrange(3)
            assert audits.add(parent, letter) == len(lists)
            lists.append([*lists[parent], letter])
        assert all(audits.letters(i) == x for i, x in enumerate(lists))
        for _ in range(3000):
            a, b = draw.randrange(len(lists)), draw.randrange(len(lists))
            if a != b and lists[a] != lists[b]:
                assert audits.less(a, b) == (lists[a] < lists[b])
            assert audits.lifted(a, len(lists[a]) // 2) in range(len(lists))


def test_cheapest_edits_of_all_short_conversations():
    kinds = [("user", "x."), ("assistant", "y."), ("system", "z."), ("tool", "t."), ("user", "cut"), ("assistant", "")]
    for n in range(5):
        for chosen in itertools.product(kinds, repeat=n):
            rows = [(role, f"{i}{text}" if text and (i or role != "tool") else text) for i, (role, text) in enumerate(chosen)]
            got = cv.judged([*range(n)], rows, False)
            assert (got["cost"], got["audit"]) == plain_audit(tuple(rows))


def test_against_plain_search(spark):
    rows = drawn(5, 150, long=80)
    rows += [(900 + i, 1, "user", "Same.", "clash", 7) for i in range(40)] + [(7, 3, "user", "Twice.", "clash", 7)] * 3
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("most", [1, 2, 5, 33])
def test_split_conversations(spark, most):
    rows = drawn(11, 20, long=160) + [(3000, None, "user", "All the same", "clash", 7)] * 40
    assert found(spark, rows, most_rows=most) == plain(rows)
    assert found(spark, rows, most_chars=most) == plain(rows)


def test_repaired_rows(spark):
    rows = drawn(8, 60, long=50)
    docs = cv.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    wanted = plain(rows)
    for most in (3, cv.ROWS):
        got = {}
        for r in sorted(cv.repaired(docs, most).collect(), key=lambda r: (r.part, r.seq, r.place)):
            got.setdefault(r.conv_id, []).append(r)
        assert {k: "".join(r.edit for r in v) for k, v in got.items()} == {k: v[6] for k, v in wanted.items() if v[6]}
        assert all(sha256("\n".join(f"{r.role}:{r.text}" for r in v if r.edit != "D").encode()).hexdigest() == wanted[k][7] for k, v in got.items())


def test_other_keys_and_no_rows(spark):
    docs = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.audit, r.cost) for r in cv.audits(cv.undamaged(docs)).collect()}
    assert got == {"a": ("KK", 0), "b": ("IK", 2)}
    assert cv.audits(cv.damaged(docs.limit(0))).count() == 0


def test_query_has_sql():
    assert "op11_persistent_audit" in QUERIES and "op11_persistent_audit" in ORACLES
