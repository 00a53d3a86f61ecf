"""Conversation structure repair by a persistent audit DP (operator 11).

A conversation's rows, in order, are edited so that the initials of its roles read ``(s?(ua)+)?``: an optional system row, then turns of
user and assistant. A row is kept (cost 0), given the role user or assistant (2) or deleted (3); a row with an empty text and the role that
fits can be inserted anywhere (2). Blank and repeated rows must be deleted; a truncated row that stays costs 1 more. The
audit is the cheapest list of edits, K, R, D and I in order; of equally cheap ones the first by ASCII.

The DP goes row by row over four states (nothing yet, after s, after u, after a). A state holds its cost and the last node of its audit. An
audit is a path of linked nodes: lists that begin alike share the nodes of their beginning. A node has its ancestors at distances
1, 2, 4, ... and a rolling hash of its path, so two audits of equal cost are compared by lifting both to one depth and
then up to where the paths part; if the nodes above are not one node, their letters are compared, and if a hash lied,
the audits are. No list of edits is copied or compared whole.

Scale: rows are range-partitioned and sorted by conversation and turn, once; a task reads them as a stream. A conversation that lies inside
of one partition is judged there. One at a partition's edge, or with more than ``ROWS`` rows or ``CHARS`` characters, is written as segments.
Of each segment the 16 costs between states at its start and end are found, and how their audits compare; a conversation's segments meet as
these few numbers in a DP of the same kind (the letters are then ranks), the way found goes back to the segments, and their repaired
texts pass through the hash in order, as a stream. So a conversation with a third of all rows is read by many tasks, and only
the numbers of its segments, its audit and the hash of its texts are one task's work. Repeated rows are found by the least segment with a
(role, text), after one row a segment; only split conversations need that.

Defined results: rows of one turn follow by role, then by text (its first 100 characters, then its hash); a null turn comes first and makes
no gap; null roles and texts are one space; a role that is empty, or begins with another letter than s, u or a, fits nowhere; null conv_ids
are one conversation; a conversation without rows has cost 0 and an empty audit; repeated rows of the table are rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import md5, sha256
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, partitions, small_batches

ROWS, CHARS = 1024, 1 << 20
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: (state, initial) -> state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State -> the initial that a new row can have there.
FITS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: State at the end -> (cost, edits) that complete the last turn.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\v\f\r"
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """Lists of letters (small numbers) that share their beginnings: node 0 is the empty list, another node its parent's list and a letter."""

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash, self.up = [0], [0], [0], [()]

    def add(self, parent: int, letter: int) -> int:
        node, ups = len(self.letter), [parent]
        while len(self.up[ups[-1]]) > len(ups) - 1:
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + letter + 1) % self.prime)
        self.up.append(tuple(ups))
        return node

    def extended(self, node: int, letters) -> int:
        for letter in letters:
            node = self.add(node, letter)
        return node

    def lifted(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def letters(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]

    def _same(self, a: int, b: int) -> bool:
        """Whether two lists of one length are equal, letter by letter up to where they share nodes."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's list comes before b's."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, self.depth[a] - depth), self.lifted(b, self.depth[b] - depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.letters(a) < self.letters(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self._same(self.up[x][0], self.up[y][0]):
            return self.letters(a) < self.letters(b)
        return self.letter[x] < self.letter[y]


def _moves(initial: str, gone: bool, cut: bool) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """For each state after a row of this kind: (state before it, cost, letters) of the best edits, rows inserted before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        state, edits, cost = before, "", 0
        for _ in range(3):
            stay = TRUNCATED * cut
            ways = [(state, "D", DELETE)]
            if not gone:
                ways.append((NEXT[state, FITS[state]], "R", RELABEL + stay))
                if (state, initial) in NEXT:
                    ways.append((NEXT[state, initial], "K", stay))
            for after, letter, more in ways:
                way = cost + more, edits + letter
                if (before, after) not in best or way < best[before, after]:
                    best[before, after] = way
            state, edits, cost = NEXT[state, FITS[state]], edits + "I", cost + INSERT
    return [[(before, *best[before, after]) for before in STATES if (before, after) in best] for after in STATES]


MOVES = {(i, g, c): [[(b, cost, tuple(map(ord, letters))) for b, cost, letters in to] for to in _moves(i, g, c)] for i, g, c in product(("s", "u", "a", ""), (False, True), (False, True))}


def best_paths(kinds: list[tuple[str, bool, bool]], start: int = START) -> tuple[Audits, list[tuple[int, int] | None]]:
    """(audits, (cost, node) for each state after the rows): the cheapest edits of rows of these kinds (initial, must go, truncated)."""
    audits = Audits()
    now: list[tuple[int, int] | None] = [None] * 4
    now[start] = (0, 0)
    for kind in kinds:
        new: list[tuple[int, int] | None] = []
        for ways in MOVES[kind]:
            reached = [(now[before][0] + cost, now[before][1], letters) for before, cost, letters in ways if now[before]]
            if not reached:
                new.append(None)
                continue
            least = min(r[0] for r in reached)
            found = None
            for cost, node, letters in reached:
                if cost == least:
                    node = audits.extended(node, letters)
                    if found is None or audits.less(node, found):
                        found = node
            new.append((least, found))
        now = new
    return audits, now


def closed(audits: Audits, now: list[tuple[int, int] | None], letters_of=lambda edits: map(ord, edits)) -> tuple[int, int, int]:
    """(cost, node, state before the ending) of the best whole audit."""
    found = None
    for state in STATES:
        if now[state]:
            cost, edits = ENDING[state]
            cost, node = now[state][0] + cost, audits.extended(now[state][1], letters_of(edits))
            if found is None or cost < found[0] or cost == found[0] and audits.less(node, found[1]):
                found = cost, node, state
    return found


def applied(edits: str, rows: list[tuple[str, str]], state: int = START) -> tuple[list[tuple[str, str | None, str | None]], int]:
    """((edit, role, text) in order, state after them): what the edits make of rows(role, text). A deleted row keeps no role."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            out.append(("D", None, None))
            at += 1
            continue
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        role = role if edit == "K" else NAMES[FITS[state]]
        state = NEXT[state, role[:1]]
        out.append((edit, role, text))
    return out, state


def faults(rows: list[tuple[str, str]], seen: set) -> list[str]:
    """The first fault of each row (role, text): blank, duplicate, truncated or none. seen: digests of rows before these."""
    out, seen = [], set(seen)
    for role, text in rows:
        digest, shown = _digest(role, text), text.strip(_SPACE)
        out.append("blank" if not shown else "duplicate" if digest in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add(digest)
    return out


def _digest(role: str, text: str) -> bytes:
    return md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _kinds(rows, found) -> list[tuple[str, bool, bool]]:
    return [(role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated") for (role, _), fault in zip(rows, found, strict=True)]


def _facts(turns: list[int | None], rows: list[tuple[str, str]], found: list[str]) -> dict:
    """Counts of a stretch of rows, and what its neighbours need to know of its edges."""
    known = [t for t in turns if t is not None]
    initials = [role[:1] for role, _ in rows]
    return {
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
        "first": initials[0] if rows else None,
        "last": initials[-1] if rows else None,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        **{name: found.count(name) for name in ("blank", "duplicate", "truncated")},
    }


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_RESULT = [*((name, pa.int64()) for name in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", _REPAIRED)]
_RESULT_SQL = ", ".join(f"{name} long" for name in _COUNTS) + ", audit string, repaired_sha256 string, repaired array<struct<edit string, role string, text string>>"
_SEGMENT = [("part", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_SEGMENT_SQL = "part long, seq long, turns array<long>, roles array<string>, texts array<string>"


def judged(turns: list[int | None], rows: list[tuple[str, str]], with_rows: bool) -> dict:
    """The result columns of a conversation whose rows (role, text) are all here, in order."""
    found = faults(rows, set())
    facts = _facts(turns, rows, found)
    audits, now = best_paths(_kinds(rows, found))
    cost, node, _ = closed(audits, now)
    edits = "".join(map(chr, audits.letters(node)))
    repaired = applied(edits, rows)[0]
    hashed = sha256(b"\n".join(_line(role, text) for edit, role, text in repaired if edit != "D")).hexdigest()
    gaps = facts["high"] - facts["low"] + 1 - facts["turns"] if facts["turns"] else 0
    return {"gaps": gaps, **{k: facts[k] for k in _COUNTS[1:-1]}, "cost": cost, "audit": edits, "repaired_sha256": hashed, "repaired": [dict(zip(("edit", "role", "text"), r, strict=True)) for r in repaired] if with_rows else None}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with damage by crc32 of conv_id:turn modulo 20: role and text are null where the row is dropped; copies is 2 where it is repeated."""
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(d == 0, None).when(d == 1, "").when(d == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(d == 0, None).when(d == 4, "user").otherwise(or_space("role"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(d == 3, 2).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    keys = ["conv_id", "turn", "role", "prefix", "h", "n"]
    keyed = rows.withColumns({"prefix": F.substring("text", 1, 100), "h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select("conv_id", "turn", "role", "text", "copies", F.spark_partition_id().cast("long").alias("part"))


def _read(most_rows: int, most_chars: int, with_rows: bool):
    """A map over ordered rows: results of the conversations that lie inside of a partition, segments of the others."""

    def run(batches):
        names = ["conv_id", "whole", *(n for n, _ in _RESULT + _SEGMENT)]

        def batch_of(out):
            kinds = [kept, pa.bool_(), *(t for _, t in _RESULT + _SEGMENT)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, kinds, strict=True)], names)

        out, kept, size = [], None, 0
        current, part, seq, first = None, None, 0, True
        turns, rows, chars, split = [], [], 0, False

        def segment():
            nonlocal turns, rows, chars, seq
            out.append({"conv_id": current[0], "whole": False, "part": part, "seq": seq, "turns": turns, "roles": [r for r, _ in rows], "texts": [t for _, t in rows]})
            turns, rows, chars, seq = [], [], 0, seq + 1

        def ended(edge):
            nonlocal turns, rows, chars, split
            if edge or split:
                segment()
            else:
                out.append({"conv_id": current[0], "whole": True, **judged(turns, rows, with_rows)})
            turns, rows, chars, split = [], [], 0, False

        for batch in batches:
            kept = batch.schema.field(0).type
            for conv_id, turn, role, text, copies, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = place
                if current is None or conv_id != current[0]:
                    if current is not None:
                        ended(first)
                        first = False
                    current = (conv_id,)
                if role is not None:
                    if len(rows) >= most_rows or chars >= most_chars:
                        split = True
                        segment()
                    for _ in range(copies):
                        turns.append(turn)
                        rows.append((role, text))
                        chars += len(text)
                        size += len(text)
                if len(out) >= 256 or size > 1 << 23:
                    if out:
                        yield batch_of(out)
                    out, size = [], 0
        if current is not None:
            ended(True)
        if out:
            yield batch_of(out)

    return run


_FACTS = ["low", "high", "turns", "illegal", "blank", "duplicate", "truncated"]
_EDGES = ["first", "last"]
_TRANSFER_SQL = "part long, seq long, " + ", ".join(f"{n} long" for n in _FACTS) + ", first string, last string, costs array<long>, ranks array<long>"


def _transfers(batches):
    """Of segments (conv_id, part, seq, turns, roles, texts, seen): facts, costs from state to state (-1: none) and how the audits from one state compare."""
    for batch in batches:
        out = []
        for _, part, seq, turns, roles, texts, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = list(zip(roles, texts, strict=True))
            found = faults(rows, set(seen or ()))
            kinds, costs, ranks = _kinds(rows, found), [], []
            for start in STATES:
                audits, now = best_paths(kinds, start)
                order = sorted(audits.letters(x[1]) for x in now if x)
                costs += [x[0] if x else -1 for x in now]
                ranks += [order.index(audits.letters(x[1])) if x else -1 for x in now]
            out.append({"part": part, "seq": seq, **_facts(turns, rows, found), "costs": costs, "ranks": ranks})
        names = ["part", "seq", *_FACTS, *_EDGES, "costs", "ranks"]
        kinds = [pa.int64()] * (2 + len(_FACTS)) + [pa.string()] * 2 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in out], t) for n, t in zip(names, kinds, strict=True))], ["conv_id", *names])


_WAY_SQL = "part long, seq long, start int, stop int, ending string, " + ", ".join(f"{n} long" for n in _COUNTS)


def _ways(table: pa.Table) -> pa.Table:
    """One conversation's segments: the states through which its best audit passes them, and its counts (on its last segment)."""
    rows = sorted(table.drop_columns(["conv_id"]).to_pylist(), key=lambda r: (r["part"], r["seq"]))
    audits, now = Audits(), [(0, 0), None, None, None]
    for r in rows:
        new: list[tuple[int, int] | None] = []
        for after in STATES:
            reached = [(now[b][0] + r["costs"][4 * b + after], now[b][1], b) for b in STATES if now[b] and r["costs"][4 * b + after] >= 0]
            least, found = min((x[0] for x in reached), default=None), None
            for cost, node, before in reached:
                if cost == least:
                    # a letter holds the rank among the audits from one state, then the states
                    node = audits.add(node, 16 * r["ranks"][4 * before + after] + 4 * before + after)
                    if found is None or audits.less(node, found):
                        found = node
            new.append(None if found is None else (least, found))
        now = new
    cost, node, state = closed(audits, now, lambda edits: ())
    way = audits.letters(node)
    known = [r for r in rows if r["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - (sum(r["turns"] for r in known) - shared) if known else 0
    filled = [r for r in rows if r["first"] is not None]
    between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:], strict=False))
    counts = {"gaps": gaps, **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost}
    counts["illegal"] += between
    last = len(rows) - 1
    values = {
        "part": [r["part"] for r in rows],
        "seq": [r["seq"] for r in rows],
        "start": [letter % 16 // 4 for letter in way],
        "stop": [letter % 4 for letter in way],
        "ending": [ENDING[state][1] if i == last else "" for i in range(len(rows))],
        **{k: [v if i == last else None for i in range(len(rows))] for k, v in counts.items()},
    }
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values.values(), kinds, strict=True)], list(values))


def _edited(batches):
    """Segments (conv_id, part, seq, turns, roles, texts, seen) with start, stop, ending: their edits and repaired rows."""
    for batch in batches:
        audits_, repaired = [], []
        for roles, texts, seen, start, stop, ending in zip(*(batch.column(n).to_pylist() for n in ("roles", "texts", "seen", "start", "stop", "ending")), strict=True):
            rows = list(zip(roles, texts, strict=True))
            audits, now = best_paths(_kinds(rows, faults(rows, set(seen or ()))), start)
            edits = "".join(map(chr, audits.letters(now[stop][1]))) + ending
            audits_.append(edits)
            repaired.append([dict(zip(("edit", "role", "text"), r, strict=True)) for r in applied(edits, rows, start)[0]])
        values = [batch.column(n) for n in ("conv_id", "part", "seq", *_COUNTS)]
        yield pa.RecordBatch.from_arrays([*values, pa.array(audits_, pa.string()), pa.array(repaired, _REPAIRED)], ["conv_id", "part", "seq", *_COUNTS, "audit", "repaired"])


def _hashed(batches):
    """Edited segments in order -> one row a conversation; texts pass through the hash and are not kept."""
    current, kept, audit, hashed, any_ = None, None, [], None, False

    def row(counts):
        values = [pa.array([v], t) for v, (_, t) in zip([*counts, "".join(audit), hashed.hexdigest(), None], _RESULT, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([current[0]], kept), *values], ["conv_id", *(n for n, _ in _RESULT)])

    for batch in batches:
        kept = batch.schema.field(0).type
        for conv_id, *counts, edits, repaired in zip(*(batch.column(n).to_pylist() for n in ("conv_id", *_COUNTS, "audit", "repaired")), strict=True):
            if current is None or conv_id != current[0]:
                current, audit, hashed, any_ = (conv_id,), [], sha256(), False
            audit.append(edits)
            for r in repaired:
                if r["edit"] != "D":
                    hashed.update((b"\n" if any_ else b"") + _line(r["role"], r["text"]))
                    any_ = True
            if counts[-1] is not None:  # the last segment has the counts
                yield row(counts)


def _audited(rows: DataFrame, most_rows: int, most_chars: int, with_rows: bool) -> tuple[DataFrame, DataFrame | None]:
    """(results of conversations that one task has read, edited segments of the others)."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    small_batches(spark)
    schema = f"conv_id {kind}, whole boolean, {_RESULT_SQL}, {_SEGMENT_SQL}"
    read = materialize(_in_order(rows).mapInArrow(_read(most_rows, most_chars, with_rows), schema))
    whole = read.where("whole").select("conv_id", *(n for n, _ in _RESULT))
    segments = read.where("not whole").select("conv_id", *(n for n, _ in _SEGMENT))
    if segments.isEmpty():
        return whole, None

    def digests(batches):
        for batch in batches:
            for conv_id, part, seq, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = repr(conv_id).encode()
                keys = list({md5(own + d, usedforsecurity=False).digest(): d for d in map(_digest, roles, texts)}.items())
                if keys:
                    values = [pa.array([k for k, _ in keys], pa.binary()), pa.array([d for _, d in keys], pa.binary()), pa.array([part] * len(keys)), pa.array([seq] * len(keys))]
                    yield pa.RecordBatch.from_arrays(values, ["key", "digest", "part", "seq"])

    posted = materialize(segments.select("conv_id", "part", "seq", "roles", "texts").mapInArrow(digests, "key binary, digest binary, part long, seq long"))
    first = posted.groupBy("key").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = posted.join(first, "key").where(F.struct("part", "seq") != F.col("first"))
    seen = later.groupBy("part", "seq").agg(F.collect_list("digest").alias("seen"))  # a segment has ROWS digests at most
    segments = materialize(segments.join(seen, ["part", "seq"], "left").select("conv_id", *(n for n, _ in _SEGMENT), "seen"))
    transfers = segments.mapInArrow(_transfers, f"conv_id {kind}, {_TRANSFER_SQL}")
    ways = transfers.groupBy("conv_id").applyInArrow(_ways, _WAY_SQL)
    chosen = segments.join(ways, ["part", "seq"])
    return whole, chosen.mapInArrow(_edited, f"conv_id {kind}, part long, seq long, " + ", ".join(f"{n} long" for n in _COUNTS) + ", audit string, repaired array<struct<edit string, role string, text string>>")


def audits(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    whole, edited = _audited(rows, most_rows, most_chars, False)
    if edited is not None:
        kind = dict(rows.dtypes)["conv_id"]
        ordered = edited.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
        whole = whole.unionByName(ordered.mapInArrow(_hashed, f"conv_id {kind}, {_RESULT_SQL}"))
    return whole.drop("repaired")


def repaired(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> conv_id, part, seq, place, edit, role, text: every edit with the row that it leaves (none after D), in order of part, seq, place."""
    whole, edited = _audited(rows, most_rows, most_chars, True)
    zero = F.lit(0).cast("long")
    out = whole.select("conv_id", zero.alias("part"), zero.alias("seq"), "repaired")
    if edited is not None:
        out = out.unionByName(edited.select("conv_id", "part", "seq", "repaired"))
    one: Column = F.posexplode("repaired").alias("place", "x")
    return out.select("conv_id", "part", "seq", one).select("conv_id", "part", "seq", "place", "x.*")


def op11_persistent_audit(spark, sf_dir: str) -> DataFrame:
    """All conversations, after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return audits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    """DuckDB SQL for the same rows: the cheapest rest of each conversation from its last row backwards, as (cost, edits) for the four states."""
    none, states = 1_000_000, "esua"
    to = {"e": "u", "s": "u", "u": "a", "a": "u"}

    def step(state: str) -> str:
        ways = [f"{{'c': v.{state}.c + 3, 'x': 'D' || v.{state}.x}}"]
        then = f"v.{to[state]}"
        ways.append(f"{{'c': {then}.c + 2 + k.cut + CASE WHEN k.gone THEN {none} ELSE 0 END, 'x': 'R' || {then}.x}}")
        kept = [(i, n) for (b, i), n in (((states[b], i), states[n]) for (b, i), n in NEXT.items()) if b == state]
        ways += [f"{{'c': v.{n}.c + k.cut + CASE WHEN k.gone OR k.i <> '{i}' THEN {none} ELSE 0 END, 'x': 'K' || v.{n}.x}}" for i, n in kept]
        return f"list_sort([{', '.join(ways)}])[1] AS {state}"

    def inserted(state: str) -> str:
        one = to[state]
        two = to[one]
        return f"list_sort([{state}, {{'c': {one}.c + 2, 'x': 'I' || {one}.x}}, {{'c': {two}.c + 4, 'x': 'II' || {two}.x}}])[1] AS {state}"

    ending = {"e": "{'c': 0, 'x': ''}", "s": "{'c': 4, 'x': 'II'}", "u": "{'c': 2, 'x': 'I'}", "a": "{'c': 0, 'x': ''}"}
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)]] || [[CAST(ascii(c) AS BIGINT)] || list_resize([-1], 8, -1) FOR c IN string_split(key, '')]), lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END), 4294967295) % 20 AS d FROM k),
r0 AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE d <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_replace(text, '[ 	-
]+$', '') AS shown FROM r0),
r2 AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(shown, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, role[1] AS i, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS j FROM r1),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut FROM r2),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY 1),
v AS (SELECT conv_id, rows AS n, {", ".join(f"{e} AS {s}" for s, e in ending.items())} FROM f
UNION ALL SELECT conv_id, n, {", ".join(inserted(s) for s in states)} FROM (SELECT v.conv_id, v.n - 1 AS n, {", ".join(step(s) for s in states)} FROM v JOIN r k ON k.conv_id IS NOT DISTINCT FROM v.conv_id AND k.n = v.n)),
b AS (SELECT conv_id, e.c AS cost, e.x AS audit FROM v WHERE n = 0),
w AS (SELECT conv_id, audit, 1 AS k, 0 AS done, 'e' AS state, CAST([] AS VARCHAR[]) AS lines FROM b
UNION ALL SELECT conv_id, audit, k + 1, done, CASE WHEN added IS NULL THEN state ELSE added[1] END, CASE WHEN added IS NULL THEN lines ELSE lines || [added || ':' || text] END
FROM (SELECT w.conv_id, audit, k, state, lines, done + CASE audit[k] WHEN 'I' THEN 0 ELSE 1 END AS done, CASE audit[k] WHEN 'I' THEN '' ELSE text END AS text, CASE audit[k] WHEN 'D' THEN NULL WHEN 'K' THEN role ELSE CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END END AS added
  FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.done + 1 WHERE k <= length(audit))),
h AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM w WHERE k = length(audit) + 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_OP11 = _oracle()
