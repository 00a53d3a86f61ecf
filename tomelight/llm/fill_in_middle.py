"""Fill-in-middle transformation (operator 12).

A text of n lines is cut at two ranks (numbers of lines from its start) into prefix, middle and suffix, and laid out as

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text as it is

Ranks, form and order come from a hash of the seed and the document's id, so a rerun gives the same output.

The ranks are found by an indexable skip list over the lines: a link of the lowest express lane spans ``FAN`` lines, one of the
next lane ``FAN`` links, and each carries its width in lines, in code points and in bytes. A descent adds up the widths of links
that end at or before the rank, goes a lane down where the next would pass it, and walks the last few lines on the text itself. The
code points before a cut are thus known without counting those of the whole prefix again, and a cut costs FAN steps a lane.

Scale: one map over documents, no shuffle. The list is built from slices of ``SLICE`` bytes and keeps one entry for ``FAN``
lines, so beside a text and its output it holds little whatever the text is made of.

Defined results: a null or empty text is plain, with no lines; so is a text that holds one of the marks (it couldn't be restored);
a null doc_id hashes as the seed followed by nothing; a text without a line end is one line, and what follows the last line end is a
line; repeated rows give the same output each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, text_or_empty

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FAN, SLICE = 32, 1 << 20


class Lines:
    """The indexable skip list over the lines of a text in UTF-8."""

    def __init__(self, data: bytes, fan: int = FAN, size: int = SLICE):
        self.data, self.fan = data, fan
        raw, ends, points, lines, chars = np.frombuffer(data, np.uint8), [], [], 0, 0
        for start in range(0, len(raw), size):
            part = raw[start : start + size]
            breaks = np.flatnonzero(part == 10) + 1
            raised = breaks[fan - 1 - lines % fan :: fan]  # ends of every fan-th line
            before = np.cumsum((part & 0xC0) != 0x80)
            ends.append(raised + start)
            points.append(before[raised - 1] + chars)
            lines += len(breaks)
            chars += int(before[-1])
        self.n, self.chars = lines + bool(data and data[-1] != 10), chars
        ends, points = (np.concatenate([[0], *x]).astype(np.int64) for x in (ends, points))
        #: From the lowest express lane up: rows of widths in lines, code points and bytes.
        self.lanes = [np.stack([np.full(len(ends) - 1, fan), np.diff(points), np.diff(ends)], 1)]
        while len(self.lanes[-1]) > fan:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), fan)))

    def before(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) of the first ``rank`` lines."""
        lines = chars = place = link = 0
        for lane in reversed(self.lanes):
            link *= self.fan
            while link < len(lane) and lines + lane[link, 0] <= rank:
                units, points, size = lane[link].tolist()
                lines, chars, place, link = lines + units, chars + points, place + size, link + 1
        while lines < rank:
            end = self.data.find(b"\n", place) + 1 or len(self.data)
            lines, chars, place = lines + 1, chars + len(self.data[place:end].decode("utf-8", "surrogatepass")), end
        return chars, place


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transformed(doc_id: int | None, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, bytes, int | None, int | None]:
    """(lines, form, output, code points of the prefix, of the middle)."""
    lines, (h1, h2, h3, h4) = Lines(data), draws(doc_id, seed)
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return lines.n, "plain", data, None, None
    low, high = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (chars, a), (upto, b) = lines.before(low), lines.before(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_rate:
        return lines.n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), chars, upto - chars
    return lines.n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), chars, upto - chars


def restored(form: str, output: bytes) -> bytes:
    """The text that ``transformed`` was given. No mark overlaps itself, so the first one found is the one that was set."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    first, _, rest = output[len(PREFIX) :].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (other, first) if form == "spm" else (first, other)
    return prefix + middle + suffix


def _mapped(docs: DataFrame, row, columns: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [row(i, text.encode("utf-8", "surrogatepass")) for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)]
            values = [batch[0], *(pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row a row of docs: doc_id, n, form, output, prefix_chars, middle_chars. ``rate`` in a hundred are cut, ``spm_rate`` of these in spm order."""

    def row(doc_id, data):
        n, form, output, prefix, middle = transformed(doc_id, data, seed, rate, spm_rate)
        return n, form, output.decode("utf-8", "surrogatepass"), prefix, middle

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return _mapped(docs, row, ["n", "form", "output", "prefix_chars", "middle_chars"], kinds, "n long, form string, output string, prefix_chars long, middle_chars long")


def restore(rows: DataFrame) -> DataFrame:
    """rows(doc_id, form, output) -> doc_id, text: the exact texts."""
    cut = lambda at: F.substring_index(F.col("output"), at, 1)
    after = lambda at: F.expr(f"substring(output, instr(output, '{at}') + 3)")
    middle = after("<M>")
    prefix = F.when(F.col("form") == "spm", F.substring_index(after("<P>"), "<M>", 1)).otherwise(F.expr("substring(substring_index(output, '<S>', 1), 4)"))
    suffix = F.when(F.col("form") == "spm", F.expr("substring(substring_index(output, '<P>', 1), 4)")).otherwise(F.substring_index(after("<S>"), "<M>", 1))
    return rows.select("doc_id", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, middle, suffix)).alias("text"))


def op12_line_middles(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""

    def row(doc_id, data):
        n, form, output, prefix, middle = transformed(doc_id, data)
        return n, form, prefix, middle, sha256(output).hexdigest(), sha256(restored(form, output)).hexdigest()

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return _mapped(spark.read.parquet(f"{sf_dir}/documents.parquet"), row, columns, kinds, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: DuckDB SQL for the same rows: lines by splitting, cuts by joining them again.
ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS parts, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS n,
  [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
x AS (SELECT *, CASE WHEN lo = n THEN t WHEN lo = 0 THEN '' ELSE array_to_string(parts[1:lo], chr(10)) || chr(10) END AS p,
  CASE WHEN hi = n THEN t WHEN hi = 0 THEN '' ELSE array_to_string(parts[1:hi], chr(10)) || chr(10) END AS q FROM c),
y AS (SELECT *, substr(q, length(p) + 1) AS m, substr(t, length(q) + 1) AS s FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM y
"""
