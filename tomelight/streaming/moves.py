"""File events with state: deletes are held back, a create with the same content turns them into moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timers import pending_deletes

def resolve_moves(events: DataFrame, grace_ms: int = 8000, late: str = "1 second") -> DataFrame:
    """events(event, path, content_hash, event_time) -> content_hash, action (move, create, delete), old_path, new_path, at_ms.

    A delete waits ``grace_ms`` of event time. A create of the same content within it is a move; otherwise the delete
    comes out when the watermark has passed.
    """
    return pending_deletes(events, grace_ms, late)


def moved_folders(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_folder, new_folder, share): for each vanished folder the new folder that holds most of its contents.

    old, new: folder, content_hash. A folder moved if ``least`` or more of its distinct contents are there.
    """
    a, b = old.select("folder", "content_hash").distinct(), new.select("folder", "content_hash").distinct()
    gone = a.join(b.select("folder").distinct(), "folder", "left_anti")
    totals = gone.groupBy("folder").agg(F.count("*").alias("total"))
    shared = gone.alias("a").join(b.alias("b"), "content_hash").groupBy(F.col("a.folder").alias("folder"), F.col("b.folder").alias("new_folder")).agg(F.count("*").alias("n"))
    best = shared.groupBy("folder").agg(F.max_by("new_folder", F.struct("n", "new_folder")).alias("new_folder"), F.max("n").alias("n"))
    return best.join(totals, "folder").where(F.col("n") / F.col("total") >= least).select(F.col("folder").alias("old_folder"), "new_folder", (F.col("n") / F.col("total")).alias("share"))
