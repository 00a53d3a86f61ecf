"""Line dedup by winnowing over line hashes (operator 9).

A passage is a run of whole lines with ``min_words`` words or more that occurs before, in an earlier document (by
doc_id) or earlier in the same one. Its later occurrences are deleted, the first stays. Runs below ``min_words`` (50, a
parameter: shorter repeats are mostly headings, greetings and the like that documents need) are left alone.

1. Line table. A document becomes its lines that have words: a 128-bit digest of each line's words (A-Z lower-cased, white
   space collapsed), their number and the line's number in the text.
2. Winnowing. A window is a shortest run of lines, from a line or up to it, that reaches ``min_words``. The line with the least
   hash in a window is selected; a document posts its selected lines as fingerprints and nothing else. Equal passages contain
   equal windows, so they select equal lines: a repeated passage is sure to share a fingerprint.
3. Joining positions. Fingerprints that stand at two places or more go back to their documents, and the windows around them, by the
   digest of their lines, find the first place where they occur: groups are reduced to their first by an aggregate, and each later
   place is joined with that one row, never with the other places.
4. Extending. The matched windows of a document and of the document where they occurred first are lined up by position (a diagonal).
   From the windows outwards, both ways, the digests of the two documents' lines are compared one by one as long as they are
   equal; only lines that were compared are deleted. A match needs no more than ``min_words`` lines beyond its windows on either
   side, since anything longer holds another window; that bounds the lines that travel.
5. Runs of ``min_words`` or more are deleted. A run that overlaps its own first occurrence in the same document starts after it.

Blank lines carry no weight and go with the lines around them. Defined results: a null text has no lines and stays null; texts below
``min_words`` are left alone; repeated rows (same doc_id and text) count as one document and share its result; null doc_ids come
first in the order, rows with equal doc_id in the order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches, text_or_empty

MIN_WORDS = 50
#: Bytes of a line's digest.
WIDTH = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_table(text: str) -> tuple[list[int], list[int], bytes]:
    """(numbers, words, digests) of the lines that have words."""
    numbers, words, digests = [], [], []
    for number, line in enumerate(text.encode("utf-8", "replace").translate(_LOWER).split(b"\n")):
        if found := line.split():
            numbers.append(number)
            words.append(len(found))
            digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
    return numbers, words, b"".join(digests)


def windows(words: np.ndarray, digests: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, line with the least hash) of each window, by place in the line table."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words) - 1
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    forward, backward = end < n, begin >= 0
    pairs = np.unique(np.concatenate([np.stack([at[forward], end[forward]], 1), np.stack([begin[backward], at[backward]], 1)]), axis=0)
    low, high = pairs[:, 0], pairs[:, 1]
    hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)[:, 0]
    best, step = low.copy(), 1
    while (some := np.flatnonzero(low + step <= high)).size:
        other = low[some] + step
        best[some] = np.where(hashes[other] < hashes[best[some]], other, best[some])
        step += 1
    return low, high, best


def _lined(docs: DataFrame, min_words: int) -> DataFrame:
    """k, doc_id, h, numbers, words, digests: the line table of each document that reaches min_words; k is one integer a document."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch[2].to_pylist()):
                numbers, words, digests = line_table(text)
                if sum(words) >= min_words:
                    rows.append((i, np.array(numbers, "<i4").tobytes(), np.array(words, "<i4").tobytes(), digests))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0].take(take), batch[1].take(take), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["doc_id", "h", "numbers", "words", "digests"])

    text = text_or_empty()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = chosen.mapInArrow(run, "doc_id long, h long, numbers binary, words binary, digests binary")
    return materialize(found.withColumn("k", F.monotonically_increasing_id()))


def _fingerprints(lined: DataFrame, min_words: int) -> DataFrame:
    """(fingerprint, k, place): the selected lines."""

    def run(batches):
        for batch in batches:
            keys, places, prints = [], [], []
            for k, words, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = np.unique(windows(np.frombuffer(words, "<i4"), digests, min_words)[2])
                keys.append(np.full(len(best), k))
                places.append(best)
                prints.append(np.frombuffer(digests, "<i8").reshape(-1, 2)[best, 0])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (prints, keys, places)], ["fingerprint", "k", "place"])

    return lined.select("k", "words", "digests").mapInArrow(run, "fingerprint long, k long, place long")


def _around(lined: DataFrame, repeated: DataFrame, min_words: int) -> DataFrame:
    """(content, doc_id, h, k, low, high): the windows whose selected line is one of ``repeated`` (k, places)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, h, k, words, digests, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high, best = windows(np.frombuffer(words, "<i4"), digests, min_words)
                some = np.isin(best, places)
                for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True):
                    out.append((xxhash.xxh3_128_digest(digests[a * WIDTH : (b + 1) * WIDTH]), doc_id, h, k, a, b))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["content", "doc_id", "h", "k", "low", "high"])

    joined = lined.select("doc_id", "h", "k", "words", "digests").join(repeated.hint("merge"), "k").select("doc_id", "h", "k", "words", "digests", "places")
    return joined.mapInArrow(run, "content binary, doc_id long, h long, k long, low long, high long")


def extend(own: bytes, words: np.ndarray, matches: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Ranges (first and last place) to delete in a document with these line digests.

    A match: shift (place in the earlier document = place here + shift), base and lines (a part of the earlier document's
    digests, from its place base on), same (whether it is this document) and spans (the matched windows here).
    """
    mine = np.frombuffer(own, "<u8").reshape(-1, 2)
    gone = []
    total = np.concatenate([[0], np.cumsum(words)])
    for match in matches:
        theirs = np.frombuffer(match["lines"], "<u8").reshape(-1, 2)
        # places here that have a line there to be compared with
        first = max(0, match["base"] - match["shift"])
        last = min(len(mine), match["base"] + len(theirs) - match["shift"])
        there = first + match["shift"] - match["base"]
        equal = (mine[first:last] == theirs[there : there + last - first]).all(1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        starts, ends = edges[::2] + first, edges[1::2] + first
        anchors = np.array([s["low"] for s in match["spans"]])
        held = np.searchsorted(starts, anchors, side="right") - 1
        held = np.unique(held[(held >= 0) & (anchors < ends[held])])
        for a, b in zip(starts[held].tolist(), ends[held].tolist(), strict=True):
            if total[b] - total[a] >= min_words:
                # in one document, a passage can't begin before the passage that it repeats has ended
                enough = int(np.searchsorted(total, total[a] + min_words))
                gone.append((max(a, enough + match["shift"]) if match["same"] else a, b - 1))
    return [(a, b) for a, b in gone if a <= b]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, spans): line ranges to delete; h is the hash of the text."""
    small_batches(docs.sparkSession)
    lined = _lined(docs, min_words)
    posts = materialize(_fingerprints(lined, min_words))
    often = posts.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    # a document's own fingerprints: at most two a line
    repeated = posts.join(often, "fingerprint").groupBy("k").agg(F.collect_set("place").alias("places"))
    around = materialize(_around(lined, repeated, min_words))
    place = F.struct("doc_id", "h", "k", "low")
    firsts = around.groupBy("content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first")
    later = around.join(firsts, "content").where((F.col("k") != F.col("first.k")) | (F.col("low") != F.col("first.low")))
    # repeated rows (same doc_id and text) are one document
    twin = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    source = F.when(twin, F.col("k")).otherwise(F.col("first.k"))
    later = later.where(~(twin & (F.col("low") == F.col("first.low"))))
    shift = (F.col("first.low") - F.col("low")).alias("shift")
    diagonals = later.select("k", source.alias("source"), shift, "low", "high").groupBy("k", "source", "shift")
    # a diagonal's windows: at most two a line of the document
    diagonals = materialize(diagonals.agg(F.min("low").alias("a"), F.max("high").alias("b"), F.collect_set(F.struct("low", "high")).alias("spans")))
    base = F.greatest(F.lit(0).cast("long"), F.col("a") + F.col("shift") - min_words)
    size = F.col("b") + F.col("shift") + min_words + 1 - base
    part = F.substring("digests", (base * WIDTH + 1).cast("int"), (size * WIDTH).cast("int"))
    match = F.struct("shift", base.alias("base"), part.alias("lines"), (F.col("k") == F.col("source")).alias("same"), "spans")
    matches = diagonals.join(lined.select(F.col("k").alias("source"), "digests"), "source").select("k", match.alias("match"))
    matches = matches.groupBy("k").agg(F.collect_list("match").alias("matches"))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, h, numbers, words, digests, matches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = np.frombuffer(numbers, "<i4")
                spans = extend(digests, np.frombuffer(words, "<i4"), matches, min_words)
                if spans:
                    out.append((doc_id, h, [{"low": int(number[a]), "high": int(number[b])} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "h", "spans"])

    joined = lined.join(matches.hint("merge"), "k").select("doc_id", "h", "numbers", "words", "digests", "matches")
    return joined.mapInArrow(run, "doc_id long, h long, spans array<struct<low:int,high:int>>")


def _apply(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """(text without the spans, lines, deleted lines, merged spans); blank lines inside or after a span go with it."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for low, high in spans:
        gone[low : high + 1] = True
    blank = [not line.strip(" \t\n\r\x0b\x0c") for line in lines]
    for i in range(1, len(lines)):
        if blank[i] and gone[i - 1] and not gone[i]:
            gone[i] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    merged = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    return "\n".join(line for line, out in zip(lines, gone.tolist(), strict=True) if not out), len(lines), int(gone.sum()), merged


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a row of docs: doc_id, text (what stays), n_lines, n_deleted, spans (first and last line of each run), text_crc32."""
    runs = repeated_runs(docs, min_words)
    # repeated rows have one result
    grouped = materialize(runs.groupBy("doc_id", "h").agg(F.first("spans").alias("spans"))).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "spans")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    # both sides grow with the corpus, so the join shuffles at every size
    joined = rows.join(grouped.hint("merge"), rows["doc_id"].eqNullSafe(grouped["d"]) & (rows["h"] == grouped["g"]), "left")

    def run(batches):
        for batch in batches:
            texts, lines, deleted, runs = [], [], [], []
            for text, spans in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                if spans:
                    kept, n, out, merged = _apply(text, [(s["low"], s["high"]) for s in spans])
                else:
                    kept, n, out, merged = text, (text.count("\n") + 1 if text else 0), 0, []
                texts.append(kept)
                lines.append(n)
                deleted.append(out)
                runs.append([{"low": a, "high": b} for a, b in merged])
            crc = [zlib.crc32((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(deleted, pa.int64()), pa.array(runs, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), pa.array(crc, pa.int64())], ["doc_id", "text", "n_lines", "n_deleted", "spans", "text_crc32"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, n_lines long, n_deleted long, spans array<struct<low:int,high:int>>, text_crc32 long")


def op9_line_winnowing(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, text, n_lines, n_deleted, spans, text_crc32."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
