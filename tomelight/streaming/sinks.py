"""Writers for streams: upserts into a Parquet table and pushed changes, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.sets import compare, upsert


def upsert_batches(path: str, keys: list[str], newer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch becomes a new version of the table under ``path``.

    Versions are folders named by the batch id, so a batch that is run again writes the same version and no other.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = number - 1
        latest = batch
        if last >= 0:
            latest = upsert(spark.read.parquet(f"{path}/v{last:09d}"), batch, keys, newer)
        latest.write.mode("overwrite").parquet(f"{path}/v{number:09d}")

    return write


def drop_folder(spark, path: str, glob: str = "*"):
    """A stream of files that arrive in a folder: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)


def rescanned(known: DataFrame, listing: DataFrame, key: str = "path", values: tuple[str, ...] = ("length", "modificationTime")) -> DataFrame:
    """(key, change) after events were lost (a watcher's overflow): the stored listing against a fresh one.

    added, removed and changed files are what the lost events would have said; files that are the same give no row. Run it as a
    batch job beside the stream and feed its rows to the same sink.
    """
    return compare(known, listing, [key], list(values)).where("change <> 'same'")
