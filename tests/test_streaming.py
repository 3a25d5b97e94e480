"""Streams run to their end over files, against what the same rows give in a batch."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from reelspark.streaming import streams

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def feed(spark, tmp_path, rows, kinds, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, kinds).write.parquet(path)
    return spark.readStream.schema(kinds).parquet(path)


def finish(df, name, mode):
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_touch_at_the_gap(spark, tmp_path):
    rows = [("a", "p", START + timedelta(seconds=s), 0.5) for s in (0, 30, 60.000001)]
    own = streams.hit_sessions(feed(spark, tmp_path, rows, "asset_id string, source_path string, ts timestamp, score double", "hits"), 15)
    assert sorted(r["hits"] for r in finish(own, "sessions", "complete").collect()) == [1, 2]


def test_hour_slices(spark, tmp_path):
    rows = [("s", "camera-001", START + timedelta(minutes=m)) for m in (5, 50, 61)]
    kinds = "source_slug string, camera_id string, moment timestamp"
    got = finish(streams.slices_per_hour(feed(spark, tmp_path, rows, kinds, "slices")), "slices", "complete").orderBy("hour").collect()
    assert [r["attempts"] for r in got] == [2, 1]
    paths = streams.hour_slices(spark.createDataFrame(rows, kinds)).select("path").distinct().count()
    assert paths == 3


def test_best_match(spark, tmp_path):
    rows = [("a", 1, "p", "full", (x, 0, 5, 5, 0.5), s) for x, s in ((1, 0.2), (2, 0.9), (3, 0.4))]
    kinds = "asset_id string, timestamp_us long, source_path string, region_kind string, region struct<x int, y int, width int, height int, scale double>, score double"
    assert finish(streams.best_matches(feed(spark, tmp_path, rows, kinds, "matches")), "best", "complete").first()["region"]["x"] == 2


def test_best_match_forgets(spark, tmp_path):
    """In append mode a key comes out once the stream is far enough ahead of it."""
    kinds = "asset_id string, timestamp_us long, source_path string, region_kind string, region struct<x int, y int, width int, height int, scale double>, score double"
    path = str(tmp_path / "m")
    for at, s in ((1, 0.2), (1, 0.9), (4_000_000_000, 0.4), (4_000_000_001, 0.1)):
        spark.createDataFrame([("a", at, "p", "full", (0, 0, 5, 5, 0.5), s)], kinds).coalesce(1).write.mode("append").parquet(path)
        own = streams.best_matches(streams.arriving(spark, path, kinds, 1))
        own.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["timestamp_us"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 0.9)]


def test_waiting_admissions(spark, tmp_path):
    """A request waits for the window; what was really used makes room; the state goes on over batches."""
    minute = 60_000_000
    kinds = "provider string, request_id long, t_us long, cost long, actual long"
    batches = [[("p", 1, 0, 600, None), ("p", 2, 10, 500, None)], [("p", 2, minute + 20, 0, 100), ("p", 3, minute + 30, 900, None)], [("p", 4, minute + 40, 900, None), ("q", 9, 5, 1, None)]]
    path = str(tmp_path / "r")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
        own = streams.waiting_admissions(streams.arriving(spark, path, kinds, 1), "provider", 5, 1000)
        own.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["request_id"]: r["admitted_us"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: minute, 3: minute + 30, 4: 2 * minute + 30, 9: 5}


def test_admissions(spark, tmp_path):
    rows = [("p", i, t * 1_000_000, c) for i, (t, c) in enumerate(((0, 600), (1, 300), (2, 200), (60, 300), (61, 300)))]
    own = streams.admissions(feed(spark, tmp_path, rows, "provider string, request_id long, t_us long, cost long", "requests"), "provider", 3, 1000)
    assert [r["admitted"] for r in finish(own, "admitted", "append").orderBy("request_id").collect()] == [True, True, False, True, True]


def test_seen_and_deduplicated(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(seconds=5)), ("b", START)]
    stream = feed(spark, tmp_path, rows, "camera_id string, ts timestamp", "cameras")
    assert finish(streams.seen(stream), "seen", "complete").filter("camera_id = 'a' and last_seen > first_seen").count() == 1
    assert finish(streams.deduplicated(stream, ["camera_id"]), "once", "append").count() == 2


def test_index_stream_restarts(spark, tmp_path):
    stream = feed(spark, tmp_path, [("a",), ("b",)], "asset_id string", "assets")
    done, written = str(tmp_path / "done"), []
    spark.createDataFrame([("a",)], "asset_id string").write.parquet(done)

    def handle(rows):
        written.extend(r["asset_id"] for r in rows.collect())
        rows.write.mode("append").parquet(done)

    for _ in range(2):  # the second run finds no new files
        streams.index_stream(stream, str(tmp_path / "cp"), handle, lambda s: s.read.parquet(done)).awaitTermination(120)
    streams.index_stream(stream, str(tmp_path / "cp2"), handle, lambda s: s.read.parquet(done)).awaitTermination(120)
    assert written == ["b"]


def test_catalogue_is_complete():
    import __spark_entry__

    own, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(own) and "semantic_search" in own and all(callable(f) for f in own.values())


def test_registry_needs_no_session():
    """Names and SQL can be read before there is a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    every, with_sql = map(int, done.stdout.split()[-2:])
    assert every >= with_sql >= 67


def test_outcome(spark):
    from reelspark.operators.cameras import outcome

    assert [r[0] for r in spark.createDataFrame([(0,), (1,)], "r int").select(outcome(F.col("r"))).collect()] == ["continue", "rediscover"]
