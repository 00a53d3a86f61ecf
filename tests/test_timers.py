"""Timers of file events: streams of a few micro-batches, each a file, in event time."""

import datetime
import os

import pytest

from tomelight.streaming import timers

T0 = datetime.datetime(2024, 1, 1)


def streamed(spark, tmp_path, schema, batches, use):
    """Rows that ``use`` of a stream gives; a batch is a list of rows whose last value is its second, and a late row closes the stream."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(*r[:-1], T0 + datetime.timedelta(seconds=r[-1])) for r in rows], schema)
        frame.coalesce(1).write.parquet(str(tmp_path / "w" / str(i)))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / "w" / str(i)).glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = use(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    name = f"t{abs(hash(str(tmp_path)))}"
    job = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert not job.isActive
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recreated_path_is_a_change(spark, tmp_path):
    schema = "event string, path string, event_time timestamp"
    batches = [
        [("delete", "/a", 1.0), ("delete", "/b", 1.0), ("delete", "/c", 1.0), ("create", "/d", 1.0), ("modify", "/d", 1.2)],
        [("create", "/a", 1.4), ("create", "/b", 1.6), ("delete", "/e", 2.0)],
        [("create", "/z", 60.0)],
        [("create", "/z", 120.0)],
    ]
    found = {(p, a, round(t / 1000 - T0.replace(tzinfo=datetime.UTC).timestamp(), 1)) for p, a, t in streamed(spark, tmp_path, schema, batches, timers.debounced_deletes) if p != "/z"}
    assert found == {("/a", "modify", 1.4), ("/b", "delete", 1.0), ("/b", "create", 1.6), ("/c", "delete", 1.0), ("/d", "create", 1.0), ("/d", "modify", 1.2), ("/e", "delete", 2.0)}


def test_file_written_for_ever_comes_out(spark, tmp_path):
    schema = "path string, event_time timestamp"
    forever = [("/big", 2.0 * i) for i in range(100)]  # every two seconds, for 200 s
    batches = [[*forever[:40], ("/small", 0.0), ("/small", 2.5)], forever[40:], [("/end", 1000.0)], [("/end", 2000.0)]]
    start = int(T0.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    found = sorted((k, (f - start) / 1000, (last - start) / 1000, n, why, (at - start) / 1000) for k, f, last, n, why, at in streamed(spark, tmp_path, schema, batches, timers.settled_writes) if k != "/end")
    assert found == [("/big", 0.0, 118.0, 60, "longest", 120.0), ("/big", 120.0, 198.0, 40, "quiet", 201.0), ("/small", 0.0, 2.5, 2, "quiet", 5.5)]


def test_library_waits_a_day_at_most(spark, tmp_path):
    schema = "library long, event_time timestamp"
    writes = [(1, 20.0 * i) for i in range(4400)] + [(2, 0.0)]  # every 20 s for more than a day
    use = lambda s: timers.settled_writes(s, "library", 30_000, 24 * 3600_000)
    found = streamed(spark, tmp_path, schema, [writes, [(3, 200_000.0)], [(3, 300_000.0)]], use)
    assert sorted((k, why, at - f) for k, f, _, _, why, at in found if k in "12") == [("1", "longest", 24 * 3600_000), ("1", "quiet", (4400 - 4320 - 1) * 20_000 + 30_000), ("2", "quiet", 30_000)]


def test_equal_files_moved_together(spark, tmp_path):
    schema = "event string, path string, content_hash string, event_time timestamp"
    batches = [
        [("delete", "/a", "h", 0.0), ("delete", "/b", "h", 0.0), ("delete", "/old/x", "i", 0.0), ("delete", "/old/y", "j", 0.0), ("delete", "/old/z", "k", 0.0), ("delete", "/q", "m", 0.0)],
        [("create", "/n/b", "h", 3.0), ("create", "/n/c", "h", 3.0), ("create", "/new/x", "i", 4.0), ("create", "/new/y", "j", 4.0), ("create", "/n/d", "h", 5.0)],
        [("create", "/late", "m", 9.0), ("create", "/end", "e", 100.0)],
        [("create", "/end", "e", 200.0)],
    ]
    rows = [r for r in streamed(spark, tmp_path, schema, batches, timers.pending_deletes) if r[0] != "e"]
    assert {r[1:4] for r in rows} == {
        ("move", "/b", "/n/b"),
        ("move", "/a", "/n/c"),
        ("create", None, "/n/d"),
        ("move", "/old/x", "/new/x"),
        ("move", "/old/y", "/new/y"),
        ("delete", "/old/z", None),
        ("delete", "/q", None),
        ("create", None, "/late"),
    }
    moved = spark.createDataFrame(rows, "content_hash string, action string, old_path string, new_path string, at_ms long")
    assert [(r.old_folder, r.new_folder, r.files) for r in timers.folder_moves(moved).collect() if r.old_folder] == [("/old", "/new", 2)]
