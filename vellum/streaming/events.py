"""Event streams: folding, deduplication, rate limits and sessions.

Each operator takes a DataFrame. Those that only need grouping or watermarks run on a stream as
they are; the ordered ones have a streaming form of their own below.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests allowed in an hour; fixed values.
LIMITS = {"upload": 30, "analyze": 20, "rewrite": 10}


def sliding_limit(requests: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """requests (kind, identity, ts) -> also used, in the window that ends with each request, and allowed.

    A very active identity would be one task; its rows are windowed by identity, kind and time
    range together with the range before, so no range holds more than two windows' rows.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    span = F.floor(micros / (seconds * 1_000_000))
    keyed = requests.withColumn("__us", micros).withColumn("__span", span)
    # Each row also counts for the next range, where it is only context.
    both = keyed.withColumn("__in", F.explode(F.array(F.col("__span"), F.col("__span") + 1)))
    order = Window.partitionBy("kind", "identity", "__in").orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    counted = both.withColumn("used", F.count("*").over(order)).filter("__in = __span")
    return counted.withColumn("allowed", F.col("used") <= limit).drop("__us", "__span", "__in")


def tumbling_limit(requests: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """(kind, identity, start, used, over, retry_after): requests in each fixed window, and the seconds from its last request to its end; runs on a stream with a watermark."""
    grouped = requests.groupBy("kind", "identity", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("used"), F.max("ts").alias("last"))
    left = F.timestamp_diff("SECOND", F.date_trunc("SECOND", F.col("last")), F.col("w.end")).cast("int")
    return grouped.select("kind", "identity", F.col("w.start").alias("start"), "used", (F.col("used") > limit).alias("over"), F.when(F.col("used") > limit, left).alias("retry_after"))


def first_arrivals(events: DataFrame, *keys: str, by: str = "seq") -> DataFrame:
    """The first event of each key, in batch; start_once is the form for a stream."""
    return events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), by).alias("e")).select(*keys, "e.*")


def latest_by_key(events: DataFrame, *keys: str, by: str = "seq") -> DataFrame:
    """The last event of each key wins: an aggregate, so a hot key is combined before the shuffle."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), by).alias("e")).select(*keys, "e.*")


def stage_durations(stages: DataFrame) -> DataFrame:
    """(analysis_id, seq, type, at) -> also ended_at: when the next stage of the analysis begins."""
    return stages.withColumn("ended_at", F.lead("at").over(Window.partitionBy("analysis_id").orderBy("at", "seq")))


def quiet_sessions(events: DataFrame, gap: str = "600 milliseconds") -> DataFrame:
    """(key, started, n, last_value): bursts that end after a quiet period, each with its last value; runs on a stream too."""
    return events.groupBy("key", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("last_value")).select("key", F.col("s.start").alias("started"), "n", "last_value")


def since_reset(events: DataFrame) -> DataFrame:
    """The events of each analysis after its last `reset`; all of them if it was never reset."""
    resets = events.filter("type = 'reset'").groupBy(F.col("analysis_id").alias("__of")).agg(F.max("seq").alias("__reset"))
    joined = events.join(resets, F.col("analysis_id").eqNullSafe(F.col("__of")), "left")
    return joined.filter("__reset is null or seq > __reset").drop("__of", "__reset")


def before_cancel(events: DataFrame) -> DataFrame:
    """The events of each analysis before its first `cancel`: work that is under way then still ends, nothing new begins."""
    cancels = events.filter("type = 'cancel'").groupBy(F.col("analysis_id").alias("__of")).agg(F.min("seq").alias("__cancel"))
    joined = events.join(cancels, F.col("analysis_id").eqNullSafe(F.col("__of")), "left")
    return joined.filter("__cancel is null or seq < __cancel").drop("__of", "__cancel")


def fold_batch(events: DataFrame) -> DataFrame:
    """(analysis_id, seq, type, key, payload) -> one row for each analysis: its counts by type and what each type said last, since its last reset."""
    return since_reset(events).groupBy("analysis_id").agg(
        F.count("*").alias("n_events"),
        F.countDistinct(F.when(F.col("type") == "finding", F.col("key"))).alias("n_findings"),
        F.max_by("payload", F.when(F.col("type") == "stage", F.col("seq"))).alias("stage"),
        F.max_by("payload", F.when(F.col("type") == "plan", F.col("seq"))).alias("plan"),
        F.max(F.when(F.col("type") == "done", 1).otherwise(0)).alias("done"),
    )


def fold_stream(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The running state of each analysis on a stream: events, distinct findings, last stage and whether it is done.

    events: as fold_batch's, and ts, the event time, with a watermark set by the caller. A `reset`
    starts anew. The state holds the findings' keys of one analysis and is dropped when the
    watermark passes its last event by the idle time, so a drained stream ends.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, seen, stage, stage_seq, done, last = state.get if state.exists else _START
        known = set(seen)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        if (times := rows["ts"].dropna()).size:
            last = max(last, int(times.max().timestamp() * 1000))
        if (resets := (rows["type"] == "reset").to_numpy()).any():
            n, known, stage, stage_seq, done = 0, set(), None, -1, 0
            rows = rows.iloc[resets.nonzero()[0][-1] + 1 :]
        n += len(rows)
        known |= set(rows.loc[rows["type"] == "finding", "key"].dropna())
        stages = rows[rows["type"] == "stage"]
        if len(stages) and int(stages["seq"].iloc[-1]) > stage_seq:
            stage, stage_seq = stages["payload"].iloc[-1], int(stages["seq"].iloc[-1])
        done = max(done, int((rows["type"] == "done").any()))
        state.update((n, sorted(known), stage, stage_seq, done, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"analysis_id": [key[0]], "n_events": [n], "n_findings": [len(known)], "stage": [stage], "done": [done]})

    return events.groupBy("analysis_id").applyInPandasWithState(
        step,
        "analysis_id string, n_events long, n_findings long, stage string, done int",
        "n long, seen array<string>, stage string, stage_seq long, done int, last long",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


#: The state of an analysis before its first event.
_START = (0, [], None, -1, 0, 0)


def start_once(starts: DataFrame, hold: str = "60 seconds") -> DataFrame:
    """A stream of starts (analysis_id, ts) without those that repeat one within the hold time of event time."""
    return starts.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["analysis_id"])


def replay(log: DataFrame, pace: float = 1.0, longest_ms: int = 2000) -> DataFrame:
    """(analysis_id, seq, at) -> also play_at: milliseconds from the start at which a replay shows each event.

    Times run from an analysis' first event, `pace` times as fast; no wait between two events is
    longer than longest_ms. `finding-resolved` events are not shown.
    """
    order = Window.partitionBy("analysis_id").orderBy("at", "seq")
    shown = log.filter("type <> 'finding-resolved'")
    wait = F.least(F.lit(longest_ms), F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(0)) / F.lit(pace))
    return shown.withColumn("__wait", wait).withColumn("play_at", F.sum("__wait").over(order).cast("long")).drop("__wait")


def burst_index(events: DataFrame) -> DataFrame:
    """(analysis_id, seq, at) -> also place: 0, 1, ... within runs of equal timestamps."""
    order = Window.partitionBy("analysis_id").orderBy("seq")
    change = F.when(F.lag("at").over(order) == F.col("at"), 0).otherwise(1)
    run = F.sum("__new").over(order)
    marked = events.withColumn("__new", change).withColumn("__run", run)
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("analysis_id", "__run").orderBy("seq")) - 1).drop("__new", "__run")
