"""The marks of lines from a feed of findings that may be replaced, withdrawn and reset.

Feed: (analysis_id, seq, type, key, line_no, severity, category); type is finding, resolved or reset. Of the events of a
finding's key the last by seq counts: a finding replaces what the key said before, on whatever line, and resolved
withdraws it; events up to an analysis' last reset count no more. So the result doesn't depend on the order in which events come. Events without a key say nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RANKS = {"high": 3, "medium": 2, "low": 1}
MARKS = "analysis_id string, line_no int, rank int, n long, categories string"


def _rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def live_findings(feed: DataFrame) -> DataFrame:
    """(analysis_id, key, seq, line_no, rank, category): what each key says last, if it was not withdrawn. Combined before the shuffle."""
    resets = feed.filter("type = 'reset'").groupBy("analysis_id").agg(F.max("seq").alias("reset"))
    own = feed.filter("type in ('finding', 'resolved') and key is not null")
    said = F.struct("seq", (F.col("type") == "finding").alias("live"), "line_no", _rank(F.col("severity")).alias("rank"), "category")
    last = own.groupBy("analysis_id", "key").agg(F.max(said).alias("s")).join(resets, "analysis_id", "left")
    return last.filter("s.live and (reset is null or s.seq > reset)").select("analysis_id", "key", "s.seq", "s.line_no", "s.rank", "s.category")


def feed_marks(feed: DataFrame) -> DataFrame:
    """(analysis_id, line_no, rank, n, categories): the worst severity, the number and the categories of each line's live findings."""
    found = live_findings(feed).groupBy("analysis_id", "line_no")
    return found.agg(F.max("rank").alias("rank"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def in_last_order(events: DataFrame, *keys: str, of: str, by: str = "seq") -> DataFrame:
    """(keys, of, by, place): what is replaced moves to the end, so the last events of a key's items are in order of when they were said last."""
    last = events.groupBy(*keys, of).agg(F.max(by).alias(by))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by, of)))


class LineMarks(StatefulProcessor):
    """Keeps what each key said last and each line's counts; a batch touches the keys and lines that it names alone, but for a reset, which withdraws all that came before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "key string", "seq long, live boolean, line_no int, rank int, category string")
        self.lines = handle.getMapState("lines", "line_no int", "counts string")
        self.reset = handle.getValueState("reset", "seq long")

    def _count(self, row: tuple, by: int) -> None:
        """Adds a finding to its line's counts, or takes it away."""
        _, _, line, rank, category = row
        held = json.loads(self.lines.getValue((line,))[0]) if self.lines.containsKey((line,)) else {}
        name = f"{rank}/{category}" if category is not None else f"{rank}"
        held[name] = held.get(name, 0) + by
        self.lines.updateValue((line,), (json.dumps({k: n for k, n in held.items() if n}),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        since = self.reset.get()[0] if self.reset.exists() else None
        touched: dict[int, None] = {}
        for frame in rows:
            resets = frame.loc[frame["type"] == "reset", "seq"]
            if len(resets) and (since is None or int(resets.max()) > since):
                since = int(resets.max())
                self.reset.update((since,))
                for name, row in list(self.said.iterator()):
                    if row[0] <= since:
                        if row[1]:
                            self._count(tuple(row), -1)
                            touched[row[2]] = None
                        self.said.removeKey(tuple(name))
            for event in frame[frame["type"].isin(["finding", "resolved"]) & frame["key"].notna()].itertuples():
                live = event.type == "finding"
                line = None if pd.isna(event.line_no) else int(event.line_no)
                new = (int(event.seq), live, -1 if line is None else line, RANKS.get(event.severity, 1), event.category if isinstance(event.category, str) else None)
                if since is not None and new[0] <= since:
                    continue
                old = tuple(self.said.getValue((event.key,))) if self.said.containsKey((event.key,)) else None
                if old is not None and _order(old) >= _order(new):
                    continue
                for row, by in ((old, -1), (new, 1)):
                    if row is not None and row[1]:
                        self._count(row, by)
                        touched[row[2]] = None
                self.said.updateValue((event.key,), new)
        yield pd.DataFrame([self._mark(key[0], line) for line in touched], columns=["analysis_id", "line_no", "rank", "n", "categories"]).astype({"line_no": "int32", "rank": "int32", "n": "int64"})

    def _mark(self, analysis: str, line: int) -> tuple:
        held = json.loads(self.lines.getValue((line,))[0])
        if not held:
            self.lines.removeKey((line,))
        parts = [k.partition("/") for k in held]
        return analysis, line, max((int(r) for r, _, _ in parts), default=0), sum(held.values()), ",".join(sorted({c for _, has, c in parts if has}))

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """Events of one seq go as the batch form orders them."""
    return (*row[:4], row[4] is not None, row[4] or "")


def stream_marks(feed: DataFrame) -> DataFrame:
    """The marks of every line that a micro-batch changes, as an upsert by (analysis_id, line_no): n is 0 for a line that has none any more. A line of -1 is a finding without a line.

    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return feed.groupBy("analysis_id").transformWithStateInPandas(statefulProcessor=LineMarks(), outputStructType=MARKS, outputMode="Update", timeMode="None")
