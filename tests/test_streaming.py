"""The event operators on real streams from files."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.streaming import events as stream

SCHEMA = "analysis_id string, seq long, type string, key string, payload string, ts timestamp"


def drain(frame, spark, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def write_events(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files of one stream are read by their times


def events_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "5 minutes")


def test_fold_stream_matches_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    write_events(spark, path, [("a", 1, "stage", None, "parse", at(0)), ("a", 2, "finding", "f1", None, at(0)), ("a", 3, "finding", "f1", None, at(1))])
    write_events(spark, path, [("a", 4, "finding", "f2", None, at(2)), ("a", 5, "stage", None, "score", at(2)), ("a", 6, "done", None, None, at(3)), ("b", 1, "stage", None, "parse", at(3))])
    write_events(spark, path, [("b", 2, "finding", "f9", None, at(4)), ("b", 3, "reset", None, None, at(4)), ("b", 4, "stage", None, "again", None)])
    rows = drain(stream.fold_stream(events_of(spark, path)), spark, "fold", "update")
    last = {k: [r for r in rows if r.analysis_id == k][-1] for k in ("a", "b")}
    batch = {r.analysis_id: r for r in stream.fold_batch(spark.read.schema(SCHEMA).parquet(path)).collect()}
    for found in (last, batch):
        assert (found["a"].n_events, found["a"].n_findings, found["a"].stage, found["a"].done) == (6, 2, "score", 1)
        assert (found["b"].n_events, found["b"].n_findings, found["b"].stage, found["b"].done) == (1, 0, "again", 0)


def test_fold_stream_drops_idle_state(spark, tmp_path):
    path = str(tmp_path / "idle")
    for minute, key in ((0, "a"), (10, "a"), (200, "b"), (201, "b"), (202, "a")):
        write_events(spark, path, [(key, minute, "stage", None, "x", at(minute))])
    rows = drain(stream.fold_stream(events_of(spark, path), "30 minutes"), spark, "idle", "update")
    assert [r.n_events for r in rows if r.analysis_id == "a"] == [1, 2, 1]
    assert [r.n_events for r in rows if r.analysis_id == "b"] == [1, 2]


def test_start_once(spark, tmp_path):
    path = str(tmp_path / "starts")
    for minute, key in ((0, "a"), (0.5, "a"), (0.5, "b"), (30, "c"), (31, "d"), (31, "a")):
        write_events(spark, path, [(key, 0, "start", None, None, at(minute))])
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).select("analysis_id", "ts")
    rows = drain(stream.start_once(frame), spark, "starts", "append")
    assert sorted((r.analysis_id, r.ts) for r in rows) == [("a", at(0)), ("a", at(31)), ("b", at(0.5)), ("c", at(30)), ("d", at(31))]


def test_replay_and_cancel(spark):
    log = spark.createDataFrame([("a", 1, "stage", 100), ("a", 2, "category", 400), ("a", 3, "finding-resolved", 500), ("a", 4, "cancel", 9400), ("a", 5, "category", 9500), ("b", 1, "stage", 7)], "analysis_id string, seq long, type string, at long")
    played = stream.replay(log, pace=2.0).orderBy("analysis_id", "seq").collect()
    assert [(r.seq, r.play_at) for r in played] == [(1, 0), (2, 150), (4, 2150), (5, 2200), (1, 0)]
    assert [(r.analysis_id, r.seq) for r in stream.before_cancel(log).orderBy("analysis_id", "seq").collect()] == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_tumbling_limit_streams(spark, sf_dir, tmp_path):
    path = str(tmp_path / "requests")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("kind"), F.col("user_id").alias("identity"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    batch = spark.read.parquet(path)
    frame = spark.readStream.schema(batch.schema).parquet(path)
    got = {tuple(r) for r in drain(stream.tumbling_limit(frame, 2), spark, "tumbling", "complete")}
    assert got == {tuple(r) for r in stream.tumbling_limit(batch, 2).collect()}


def test_sliding_window_counts_the_hour_before(spark):
    rows = [("upload", 1, f"2024-01-01 0{h}:{m:02d}:00") for h, m in ((0, 0), (0, 59), (1, 0), (1, 1), (3, 0))]
    frame = spark.createDataFrame(rows, "kind string, identity int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.used for r in stream.sliding_limit(frame, 2).orderBy("ts").collect()] == [1, 2, 3, 3, 1]


def test_burst_index(spark):
    frame = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 5, 5, 7, 5])], "analysis_id string, seq int, at int")
    assert [r.place for r in stream.burst_index(frame).orderBy("seq").collect()] == [0, 1, 2, 0, 0]
