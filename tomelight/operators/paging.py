"""Pages that can be resumed: a cursor over an ordered table or difference, and whole tables in numbered chunks.

A cursor is a text: what it goes over (for instance two snapshots), and the sort key of the last row that was given. A page is the rows
beyond it, found by comparing keys, so no page counts or skips the rows before it, rows that come or go elsewhere do not
shift it, and a page that is asked for again is the same page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resolve import written
from .sets import compare

#: Changes in the order in which they are told.
TOLD = ("added", "changed", "removed")


def cursor(over: dict, after: list | None) -> str:
    return json.dumps({"over": over, "after": after}, separators=(",", ":"))


def beyond(order: list[str], after: list) -> Column:
    """Whether a row comes after a sort key: greater in the first column in which they differ."""
    tests = []
    for i, value in enumerate(after):
        same = [F.col(c) == F.lit(v) for c, v in zip(order[:i], after[:i], strict=True)]
        tests.append(reduce(lambda a, b: a & b, [*same, F.col(order[i]) > F.lit(value)]))
    return reduce(lambda a, b: a | b, tests)


def page_after(rows: DataFrame, order: list[str], size: int, token: str | None = None, over: dict | None = None) -> DataFrame:
    """The ``size`` rows after a cursor (the first ones without it), each with the cursor that resumes after it.

    order: columns without nulls that together are unique.
    """
    known = json.loads(token) if token else {"over": over or {}, "after": None}
    left = rows.where(beyond(order, known["after"])) if known["after"] is not None else rows
    parts = F.to_json(F.struct(*[F.col(c) for c in order]))
    # the key as a JSON list, beside what the cursor goes over
    values = F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1) for c in order]), F.lit("]"))
    head = json.dumps(known["over"], separators=(",", ":"))
    told = F.concat(F.lit(f'{{"over":{head},"after":'), values, F.lit("}"))
    return left.orderBy(*order).limit(size).withColumn("cursor", F.when(parts.isNotNull(), told))


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(told, keys): what a reader of the old snapshot must be told; told: 0 added, 1 changed, 2 removed."""
    changes = compare(old, new, keys, values).where("change <> 'same'")
    turn = reduce(lambda c, x: c.when(F.col("change") == x[1], x[0]), list(enumerate(TOLD))[1:], F.when(F.col("change") == TOLD[0], 0))
    return changes.select(turn.alias("told"), *keys, "change")


def sync(snapshot, latest: str, token: str | None, keys: list[str], values: list[str], size: int = 5, seen: str | None = None) -> tuple[list[dict], str, bool]:
    """(changes, next token, whether there is more) of one sync call.

    snapshot(name) is a stored snapshot; token: that of the call before, or None and the reader's snapshot ``seen`` (None: it
    has nothing). A token under way names both its snapshots, so later ones don't disturb its pages; when they are through, the next
    call begins at the newer one.
    """
    over = json.loads(token)["over"] if token else {"from": seen, "to": latest}
    if token and json.loads(token)["after"] is None:
        over = {"from": over["to"], "to": latest}
        token = None
    new = snapshot(over["to"])
    old = snapshot(over["from"]) if over["from"] is not None else new.limit(0)
    rows = page_after(difference(old, new, keys, values), ["told", *keys], size + 1, token, over).collect()
    more = len(rows) > size
    rows = rows[:size]
    following = rows[-1]["cursor"] if more else cursor(over, None)
    return [{k: r[k] for k in (*keys, "change")} for r in rows], following, more


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``rank`` (from 0 in this order): sorted by ranges, and one count a range; no window over the whole table."""
    spark: SparkSession = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a range
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def chunks(rows: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """(chunk, first, last, n, rows): the whole table in order as lists of ``size`` rows, made by all tasks."""
    every = F.struct(F.col("rank"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    grouped = ranked(rows, order).groupBy(F.floor(F.col("rank") / size).alias("chunk")).agg(F.sort_array(F.collect_list(every)).alias("all"))
    key = lambda i: F.element_at("all", i)["row"][order[0]]
    return grouped.select("chunk", key(1).alias("first"), key(-1).alias("last"), F.size("all").alias("n"), F.transform("all", lambda x: x["row"]).alias("rows"))


def delivered(rows: DataFrame, order: list[str], size: int = 500) -> Iterator[list[dict]]:
    """The chunks one after the other: the driver holds one partition of them at a time."""
    found = chunks(rows, order, size)
    for r in found.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("chunk").toLocalIterator():
        yield [x.asDict(recursive=True) for x in r["rows"]]


def in_given_order(rows: DataFrame, key: str, ids: DataFrame, listed: str = "ids") -> DataFrame:
    """rows of the ids in the order of a list: ids has one array column; an id that is not there is left out, one that is listed twice comes twice. ``place`` is its place."""
    return ids.select(F.posexplode(listed).alias("place", key)).join(rows, key).orderBy("place")
