"""Layout of pages from positioned text items: columns, reading order, tables, running headers.

raw_item: (doc_id, stream_index, text, page, x, y, w, h, source, table_id, row, col).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P

BINS = 100


def column_histogram(items: DataFrame) -> DataFrame:
    """(doc_id, page, bin, n): how many items cover each of 100 vertical bands."""
    low, high = F.floor(F.col("x") * BINS).cast("int"), F.least(F.lit(BINS - 1), F.ceil((F.col("x") + F.col("w")) * BINS).cast("int"))
    # Items of a page that cover the same bands are counted before the bands are told apart.
    spans = items.filter("source = 'body' and w > 0").groupBy("doc_id", "page", low.alias("low"), F.greatest(low, high).alias("high")).agg(F.count("*").alias("n"))
    covered = spans.select("doc_id", "page", F.explode(F.sequence("low", "high")).alias("bin"), "n")
    return covered.groupBy("doc_id", "page", "bin").agg(F.sum("n").alias("n"))


def longest_gap(items: DataFrame, share: float = 0.05) -> DataFrame:
    """(doc_id, page, start, width): the longest run of nearly empty bands in the middle 60%; the first of equals."""
    pages = items.filter("source = 'body' and w > 0").groupBy("doc_id", "page").agg(F.count("*").alias("items"))
    bands = pages.select("*", F.explode(F.sequence(F.lit(20), F.lit(80))).alias("bin"))
    counted = bands.join(column_histogram(items), ["doc_id", "page", "bin"], "left").fillna(0, ["n"])
    empty = counted.filter(F.col("n") <= F.col("items") * share)
    island = F.col("bin") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("bin"))
    runs = empty.withColumn("island", island).groupBy("doc_id", "page", "island").agg(F.min("bin").alias("start"), F.count("*").alias("width"))
    best = F.max_by(F.struct("start", "width"), F.struct(F.col("width"), -F.col("start"))).alias("b")
    return runs.groupBy("doc_id", "page").agg(best).select("doc_id", "page", "b.start", "b.width")


def two_columns(items: DataFrame) -> DataFrame:
    """(doc_id, page, divider, columns): 2 where a wide gap parts two blocks of five items or more, with a straight right edge that isn't only dates and that overlap vertically."""
    gap = longest_gap(items).filter("width >= 3").withColumn("divider", (F.col("start") + F.col("width") / 2) / BINS)
    split = items.filter("source = 'body' and w > 0").join(gap, ["doc_id", "page"]).withColumn("right", F.col("x") >= F.col("divider"))
    r, left = F.col("right"), ~F.col("right")
    dated = F.col("text").rlike(P.DATE_RANGE) | F.col("text").rlike(P.YEAR)
    facts = split.groupBy("doc_id", "page", "divider").agg(
        F.count("*").alias("items"), F.count_if(left).alias("n_left"), F.count_if(r).alias("n_right"), F.stddev_pop(F.when(r, F.col("x"))).alias("spread"),
        F.avg(F.when(r, (~dated).cast("int"))).alias("plain"),
        (F.least(F.max(F.when(left, F.col("y") + F.col("h"))), F.max(F.when(r, F.col("y") + F.col("h")))) - F.greatest(F.min(F.when(left, F.col("y"))), F.min(F.when(r, F.col("y"))))).alias("overlap"),
    )
    fits = (F.col("items") >= 8) & (F.col("n_left") >= 5) & (F.col("n_right") >= 5) & (F.col("spread") <= 0.04) & (F.col("plain") >= 0.4) & (F.col("overlap") >= 0.2)
    return facts.select("doc_id", "page", "divider", F.when(fits, 2).otherwise(1).alias("columns"))


def displaced(items: DataFrame) -> DataFrame:
    """(doc_id, n, moved, out_of_order): documents whose stream order differs from their reading order for over a quarter of more than ten items."""
    body = items.filter("source = 'body'")
    by_stream = F.row_number().over(Window.partitionBy("doc_id").orderBy("stream_index"))
    by_place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "x", "stream_index"))
    ranked = body.withColumn("s", by_stream).withColumn("p", by_place)
    counts = ranked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("s") - F.col("p")) > 6).alias("moved"))
    return counts.withColumn("out_of_order", (F.col("n") > 10) & (F.col("moved") > F.col("n") * 0.25))


def flattened_tables(items: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, text): each table row as the one line that a linear reader sees, cells in stream order."""
    cells = items.filter("table_id is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("stream_index", "text"))), lambda c: c["text"])
    return cells.groupBy("doc_id", "table_id", "row").agg(F.array_join(texts, " ").alias("text"))


def running_headers(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of items at the top of a page that say the same on another page, or a contact field."""
    top = items.filter("y + h < 0.055").select("doc_id", "page", F.trim("text").alias("text")).distinct()
    pages = top.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("pages"))
    contact = F.col("text").rlike(P.EMAIL) | F.col("text").rlike(P.PHONE) | F.col("text").rlike(P.URL)
    return top.join(pages, ["doc_id", "text"]).filter((F.col("pages") > 1) | contact).select("doc_id", "page", "text")


def upper_median(items: DataFrame, value: str) -> DataFrame:
    """(doc_id, median): an element of the sorted positive values, the upper one of two middles."""
    fit = items.filter(F.col(value) > 0)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(value))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return fit.withColumn("__at", at).withColumn("__n", n).filter("__at = floor(__n / 2) + 1").select("doc_id", F.col(value).alias("median"))
