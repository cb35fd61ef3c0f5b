"""The rollup of a feed as a stream against its batch form, for any cut into micro-batches and any order."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.streaming import rollup

FEED = "analysis_id string, seq long, type string, key string, line_no int, severity string, category string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def made_up(seed, n=120):
    rng = random.Random(seed)
    kinds = ["finding"] * 8 + ["resolved"] * 3 + ["reset"] * (1 if seed else 0)
    rows = [(rng.choice("ab"), i, rng.choice(kinds), rng.choice(["f1", "f2", "f3", "f4", "f5", None]), rng.randrange(4), rng.choice(["high", "medium", "low", None]), rng.choice(["parse", "impact"])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    """Marks by a loop over the events in order."""
    live = {}
    for a, _, kind, key, *said in sorted(rows, key=lambda r: r[1]):
        if kind == "reset":
            live = {k: v for k, v in live.items() if k[0] != a}
        elif key is not None:
            live.pop((a, key), None)
            if kind == "finding":
                live[a, key] = said
    marks = {}
    for (a, _), (line, severity, category) in live.items():
        rank, n, categories = marks.get((a, line), (0, 0, frozenset()))
        marks[a, line] = max(rank, rollup.RANKS.get(severity, 1)), n + 1, categories | {category}
    return {k: (r, n, ",".join(sorted(c))) for k, (r, n, c) in marks.items()}


@pytest.mark.parametrize("seed", range(3))
def test_batch_marks_equal_a_loop(spark, seed):
    rows = made_up(seed)
    got = rollup.feed_marks(spark.createDataFrame(rows, FEED)).collect()
    assert {(r.analysis_id, r.line_no): (r.rank, r.n, r.categories) for r in got} == plain(rows)


@pytest.mark.parametrize(("seed", "cuts"), [(0, [120]), (1, [7, 40, 41]), (2, [60, 90])])
def test_stream_ends_where_the_batch_does(rocks, tmp_path, seed, cuts):
    rows, path = made_up(seed), str(tmp_path / "feed")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a < b:
            rocks.createDataFrame(rows[a:b], FEED).coalesce(1).write.mode("append").parquet(path)
    state = {}

    def upsert(batch, _):
        for r in batch.collect():
            state[r.analysis_id, r.line_no] = (r.rank, r.n, r.categories)

    feed = rocks.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(path)
    query = rollup.stream_marks(feed).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(upsert).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {k: v for k, v in state.items() if v[1]} == plain(rows)


def test_what_is_replaced_moves_to_the_end(spark):
    events = spark.createDataFrame([("x", 1, "parse"), ("x", 2, "impact"), ("x", 3, "parse"), ("y", 1, "a")], "analysis_id string, seq long, category string")
    got = sorted((r.analysis_id, r.place, r.category) for r in rollup.in_last_order(events, "analysis_id", of="category").collect())
    assert got == [("x", 1, "impact"), ("x", 2, "parse"), ("y", 1, "a")]


def test_empty_feed(spark):
    none = spark.createDataFrame([], FEED)
    assert rollup.feed_marks(none).count() == 0 and rollup.live_findings(none).count() == 0
    assert rollup.feed_marks(none.unionByName(spark.createDataFrame([("a", 1, "finding", None, 1, "high", "c")], FEED))).agg(F.sum("n")).first()[0] is None
