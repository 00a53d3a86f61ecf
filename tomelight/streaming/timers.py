"""File events with timers of their own: debounced deletes, waits that end when quiet or at the latest after a limit, and pending deletes.

Each is a stateful processor by one key (a path, a library, a content). All times are event times: a timer fires when the watermark has
passed it, so a run that is repeated after a failure gives the same rows. State is a few numbers a key, and for
``PendingDeletes`` one entry a delete that still waits; it lives in RocksDB, which the functions here ask the session for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processed(events: DataFrame, key: str, processor: StatefulProcessor, output: str, late: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    rows = timed.withColumn("at_ms", F.unix_millis("event_time"))
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "append", "EventTime")


def _in_order(batches: Iterator[pd.DataFrame], deletes_first: bool = True) -> list:
    """A key's rows of this batch by time; at one time deletes come before creates."""
    rows = pd.concat(list(batches))
    if "event" in rows:
        rows = rows.assign(turn=(rows["event"] != "delete").astype(int)).sort_values(["at_ms", "turn", "path"] if "path" in rows else ["at_ms", "turn"], kind="stable")
    else:
        rows = rows.sort_values("at_ms", kind="stable")
    return list(rows.itertuples())


class DebouncedDeletes(StatefulProcessor):
    """By path: a delete waits ``wait_ms``; a create of the path within it makes it a change of the file."""

    columns = ("path", "action", "at_ms")

    def __init__(self, wait_ms: int = 500):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.deleted = handle, handle.getValueState("deleted", "at_ms long")

    def _pending(self) -> int | None:
        return self.deleted.get()[0] if self.deleted.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, pending = [], self._pending()
        before = pending
        for r in _in_order(rows):
            at = int(r.at_ms)
            if pending is not None and at - pending > self.wait_ms:
                out.append((key[0], "delete", pending))
                pending = None
            if r.event == "delete":
                pending = at  # a second delete begins the wait anew
            elif pending is not None and r.event == "create":
                out.append((key[0], "modify", at))
                pending = None
            else:
                out.append((key[0], r.event, at))
        if before is not None and before != pending:
            self.handle.deleteTimer(before + self.wait_ms)
        if pending is None:
            self.deleted.clear()
        elif pending != before:
            self.deleted.update((pending,))
            self.handle.registerTimer(pending + self.wait_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, out = self._pending(), []
        if pending is not None and pending + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], "delete", pending))
            self.deleted.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class SettledWrites(StatefulProcessor):
    """By key: a run of writes ends when none came for ``quiet_ms``, or ``most_ms`` after its first one however long it goes on."""

    columns = ("key", "first_ms", "last_ms", "writes", "ended", "at_ms")

    def __init__(self, quiet_ms: int, most_ms: int):
        self.quiet_ms, self.most_ms = quiet_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "first_ms long, last_ms long, writes long")

    def _ends(self, run) -> tuple[int, str]:
        quiet, most = run[1] + self.quiet_ms, run[0] + self.most_ms
        return (quiet, "quiet") if quiet <= most else (most, "longest")

    def _row(self, key, run) -> tuple:
        at, why = self._ends(run)
        return (key[0], run[0], run[1], run[2], why, at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = tuple(self.run.get()) if self.run.exists() else None
        before, out = run, []
        for r in _in_order(rows):
            at = int(r.at_ms)
            if run is not None and at >= self._ends(run)[0]:
                out.append(self._row(key, run))
                run = None
            run = (at, at, 1) if run is None else (run[0], max(run[1], at), run[2] + 1)
        if before is not None:
            self.handle.deleteTimer(self._ends(before)[0])
        self.run.update(run)
        self.handle.registerTimer(self._ends(run)[0])
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            run = tuple(self.run.get())
            if self._ends(run)[0] <= expiredTimerInfo.getExpiryTimeInMs():
                out.append(self._row(key, run))
                self.run.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class PendingDeletes(StatefulProcessor):
    """By content: deletes wait ``grace_ms`` in a pool; a create takes one of them, the one of its own file name first, then the oldest."""

    columns = ("content_hash", "action", "old_path", "new_path", "at_ms")

    def __init__(self, grace_ms: int = 8000):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pool = handle, handle.getMapState("pool", "path string", "at_ms long")

    def _taken(self, pool: dict, path: str) -> str | None:
        name = path.rpartition("/")[2]
        return min(pool, key=lambda p: (p.rpartition("/")[2] != name, pool[p], p), default=None)

    def _expired(self, key, pool: dict, now: int) -> list[tuple]:
        gone = sorted((at, path) for path, at in pool.items() if at + self.grace_ms < now)
        for _, path in gone:
            del pool[path]
        return [(key[0], "delete", path, None, at) for at, path in gone]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pool = {k[0]: v[0] for k, v in self.pool.iterator()} if self.pool.exists() else {}
        before, out = dict(pool), []
        for r in _in_order(rows):
            at = int(r.at_ms)
            out += self._expired(key, pool, at)
            if r.event == "delete":
                pool[r.path] = at
            elif r.event == "create":
                old = self._taken(pool, r.path)
                out.append((key[0], "create" if old is None else "move", old, r.path, at))
                pool.pop(old, None)
        for path in before.keys() - pool.keys():
            self.pool.removeKey((path,))
        for path, at in pool.items():
            if before.get(path) != at:
                self.pool.updateValue((path,), (at,))
                self.handle.registerTimer(at + self.grace_ms + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pool = {k[0]: v[0] for k, v in self.pool.iterator()} if self.pool.exists() else {}
        out = self._expired(key, pool, expiredTimerInfo.getExpiryTimeInMs())
        for row in out:
            self.pool.removeKey((row[2],))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def debounced_deletes(events: DataFrame, wait_ms: int = 500, late: str = "1 second") -> DataFrame:
    """events(event, path, event_time) -> path, action (create, modify, delete), at_ms: a path recreated within the wait is a modified file."""
    return _processed(events.select("event", "path", "event_time"), "path", DebouncedDeletes(wait_ms), "path string, action string, at_ms long", late)


def settled_writes(events: DataFrame, key: str = "path", quiet_ms: int = 3000, most_ms: int = 120_000, late: str = "1 second") -> DataFrame:
    """events(key, event_time) -> key, first_ms, last_ms, writes, ended (quiet or longest), at_ms.

    The defaults are a file's: quiet for 3 s, 120 s at most. A library that waits for copies to end: key its id, 30 s and 24 hours.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), "event_time")
    return _processed(rows, "key", SettledWrites(quiet_ms, most_ms), "key string, first_ms long, last_ms long, writes long, ended string, at_ms long", late)


def pending_deletes(events: DataFrame, grace_ms: int = 8000, late: str = "1 second") -> DataFrame:
    """events(event, path, content_hash, event_time) -> content_hash, action (move, create, delete), old_path, new_path, at_ms.

    Files of a deleted folder are rows of their own; ``folder_moves`` tells from the moves where folders went.
    """
    rows = events.select("event", "path", "content_hash", "event_time")
    return _processed(rows, "content_hash", PendingDeletes(grace_ms), "content_hash string, action string, old_path string, new_path string, at_ms long", late)


def folder_moves(moves: DataFrame, least: float = 0.5) -> DataFrame:
    """moves (rows of ``pending_deletes``) -> old_folder, new_folder, files, share: a folder went where at least ``least`` of its files went."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    gone = moves.where("action in ('move', 'delete')").select(folder("old_path").alias("old_folder"), folder("new_path").alias("new_folder"))
    counts = gone.groupBy("old_folder", "new_folder").agg(F.count("*").alias("files"))
    best = F.max_by(F.struct("new_folder", "files"), F.when(F.col("new_folder").isNotNull(), F.struct("files", "new_folder")))
    sums = counts.groupBy("old_folder").agg(F.sum("files").alias("all"), best.alias("best"))
    return sums.select("old_folder", "best.new_folder", "best.files", (F.col("best.files") / F.col("all")).alias("share")).where((F.col("share") >= least) & (F.col("old_folder") != F.col("new_folder")))
