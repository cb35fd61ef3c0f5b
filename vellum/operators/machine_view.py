"""What a machine reads of a laid-out document, against the lines that a person sees.

Positioned files are read row by row across columns; files in document order are read item by item, the cells of a
table row as one line. Every line of the machine's text names the visual lines it is made of. Lost are lines of
headers, footers and text boxes; scrambled those that share a row with another column; moved the least set of body
lines without which stream order is visual order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.alignment import chained
from vellum.operators.geometry import two_columns
from vellum.operators.layout import LOOSE, Layout
from vellum.operators.lineage import line_map
from vellum.operators.visual import numbered_rows


def with_columns(items: DataFrame) -> DataFrame:
    """items with column: 1 right of a page's divider, else 0."""
    dividers = two_columns(items).filter("columns = 2").select("doc_id", "page", "divider")
    return items.join(dividers, ["doc_id", "page"], "left").withColumn("column", F.coalesce((F.col("x") >= F.col("divider")).cast("int"), F.lit(0))).drop("divider")


def seen_lines(placed: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, source, page, column, items, text): the visual lines in the order in which they are read on the page; line: the least stream index of its items."""
    mapped = placed.join(line_map(placed).select("doc_id", F.col("source_no").alias("stream_index"), F.col("target_no").alias("line")), ["doc_id", "stream_index"])
    parts = F.array_sort(F.collect_list(F.struct("x", "stream_index", F.trim("text").alias("text"))))
    lines = mapped.groupBy("doc_id", "line").agg(
        F.min("page").alias("page"), F.min("column").alias("column"), F.min("source").alias("source"), F.min("y").alias("y"), F.min("x").alias("x"),
        F.array_sort(F.collect_list("stream_index")).alias("items"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "column", "y", "x", "line"))
    return lines.select("doc_id", place.alias("line_no"), "line", "source", "page", "column", "items", "text")


def machine_lines(layout: Layout, placed: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, row_no, text, line_nos, mangled): the machine's text. placed: items with_columns; lines: seen_lines of them."""
    files = layout.files.select("doc_id", (F.col("file_type") == "pdf").alias("positioned"))
    of_item = lines.select("doc_id", "line_no", F.explode("items").alias("stream_index"))
    own = placed.join(files, "doc_id").join(of_item, ["doc_id", "stream_index"])
    spaced = lambda parts: F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["text"]), " "), r"\s+", " "))
    bare = F.trim("text").alias("text")
    ids = F.array_sort(F.collect_set("line_no")).alias("line_nos")
    rows = numbered_rows(own.filter("positioned and source = 'body'")).groupBy("doc_id", "row_no").agg(spaced(F.struct("x", "y", "stream_index", bare)).alias("text"), ids, (F.count_distinct("column") > 1).alias("mangled"))
    # Document order: a table row stands where its first cell does.
    cell = F.col("table_id").isNotNull()
    unit = F.when(cell, F.concat_ws(":", "table_id", "row")).otherwise(F.concat(F.lit("#"), "stream_index"))
    said = F.when(cell, F.regexp_replace("text", r"^•\s*", "")).otherwise(F.col("text"))
    units = own.filter("not positioned and source in ('body', 'table')").withColumn("text", said).groupBy("doc_id", unit.alias("unit")).agg(F.min("stream_index").alias("at"), spaced(F.struct("stream_index", bare)).alias("text"), ids, (F.count_distinct("col") > 1).alias("mangled"))
    flat = units.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).select("doc_id", "row_no", "text", "line_nos", "mangled")
    return rows.select("doc_id", "row_no", "text", "line_nos", "mangled").unionByName(flat)


def moved_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no): the fewest body lines to take out so that the others' stream order is their order on the page."""
    pairs = lines.filter("source = 'body'").select("doc_id", F.col("line_no").alias("a"), F.col("line").alias("b"), F.lit(1.0).alias("weight"))
    return chained(pairs, ["doc_id"]).filter("not kept").select("doc_id", F.col("a").alias("line_no"))


def unread_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, state): lost, scrambled and moved lines; a line may be both of the latter."""
    said = lambda frame, state: frame.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.lit(state).alias("state"))
    lost = lines.filter(F.col("source").isin(*LOOSE))
    scrambled = rows.filter("mangled").select("doc_id", F.explode("line_nos").alias("line_no")).distinct()
    return said(lost, "lost").unionByName(said(scrambled, "scrambled")).unionByName(said(moved_lines(lines), "moved"))


def missing_words(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, word, n): how often the lines say a word more than the machine's text does."""
    words = lambda frame, sign: frame.select("doc_id", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"), F.lit(sign).alias("n"))
    return words(lines, 1).unionByName(words(rows, -1)).groupBy("doc_id", "word").agg(F.sum("n").alias("n")).filter("n > 0")


def view_facts(layout: Layout, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_rows, n_mangled, n_lost, n_scrambled, n_moved): one row for each file."""
    states = unread_lines(lines, rows).groupBy("doc_id").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("lost", "scrambled", "moved")])
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if("mangled").alias("n_mangled"))
    seen = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    out = layout.files.select("doc_id")
    for part in (seen, counts, states):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0)
