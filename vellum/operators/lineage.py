"""Where merged text comes from: maps from what goes into a merge to what comes out, and their composition.

Each merge of operators.visual numbers its rows before it joins them, so its map is the same
numbers without the texts. A run and a line go by the least stream index of what they hold, a paragraph by its number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.visual import numbered_lines, numbered_paragraphs, numbered_runs


def run_map(fragments: DataFrame) -> DataFrame:
    """(doc_id, source_no, target_no): from a fragment's stream index to its run's."""
    own = Window.partitionBy("doc_id", "page", "run")
    return numbered_runs(fragments).select("doc_id", F.col("stream_index").alias("source_no"), F.min("stream_index").over(own).alias("target_no"))


def line_map(items: DataFrame) -> DataFrame:
    """(doc_id, source_no, target_no): from an item's stream index to its visual line's."""
    own = Window.partitionBy("doc_id", "page", "column", "source", "line")
    return numbered_lines(items).select("doc_id", F.col("stream_index").alias("source_no"), F.min("stream_index").over(own).alias("target_no"))


def paragraph_map(lines: DataFrame, by: str = "line_no") -> DataFrame:
    """(doc_id, source_no, target_no): from a line, told by the column `by`, to the number of its paragraph."""
    return numbered_paragraphs(lines).select("doc_id", F.col(by).alias("source_no"), F.col("paragraph").alias("target_no"))


def composed(*maps: DataFrame) -> DataFrame:
    """One map for several, the first one's sources to the last one's targets; a source whose target the next map lacks has none."""

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.select("doc_id", F.col("source_no").alias("target_no"), F.col("target_no").alias("__next"))
        return first.join(onward, ["doc_id", "target_no"]).select("doc_id", "source_no", F.col("__next").alias("target_no"))

    return reduce(then, maps)


def sources(mapped: DataFrame) -> DataFrame:
    """The inverse: (doc_id, target_no, source_nos), the sources in order."""
    return mapped.groupBy("doc_id", "target_no").agg(F.array_sort(F.collect_list("source_no")).alias("source_nos"))
