"""Visual lines from positioned fragments: runs, lines, wrapped lines and the rows of a position-sorting reader.

Which run, line or row a fragment belongs to depends on the one built so far, so a small machine
numbers them as they stream by in order; texts and boxes are then plain aggregates.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.folds import run_machine

#: A year or an open end, and a range of dates or the start of one; fixed values.
DATED = r"(?i)\b(19|20)\d{2}\b|present|current"
DATE_RANGE = r"(?i)\b(19|20)\d{2}\s*(?:[–—-]|to)\s*(?:(19|20)\d{2}|present|current)|^(?:[A-Z][a-z]+\.? ?)?'?\d{2,4}\s*[–—-]"
#: Shares of the height or the font size within which heights are one, and widths of gaps; fixed values.
BASELINE, LEAST_HEIGHT, WIDE, NARROW, OVERLAP, COLUMN_GAP = 0.45, 0.004, 1.6, 0.12, 1.0, 0.06
#: How near its column's right edge a line ends that goes on, how near the next line is, and how alike the fonts; fixed values.
EDGE, LEADING, FONTS = 0.08, 0.9, 0.6
#: The order in which lines are read on the page.
LINE_ORDER = ["page", "column", "y", "line_no"]


def _run_machine():
    """Numbers runs: a fragment continues the open one on its baseline if it begins near its end. Says also whether the gap is a word's."""
    number, base, size, end = 0, 0.0, 0.0, None

    def step(x: float, y: float, w: float, font: float, ends: bool) -> tuple[int, bool]:
        nonlocal number, base, size, end
        em = max(size, font)
        gap = None if end is None else x - end
        joins = gap is not None and -OVERLAP <= gap < WIDE * em and abs(y - base) < BASELINE * em
        if not joins:
            number, base, size = number + 1, y, font
        end = None if ends else x + w
        return number, bool(joins and gap > NARROW * em)

    return step


def numbered_runs(fragments: DataFrame) -> DataFrame:
    """fragments with run, the number of the run in its page, and apart, whether a word's gap comes before."""
    return run_machine(fragments, ["doc_id", "page"], ["stream_index"], ["x", "y", "w", "font_size", "has_eol"], _run_machine, "run int, apart boolean")


def merge_runs(fragments: DataFrame) -> DataFrame:
    """Fragments (doc_id, page, stream_index, text, x, y, w, font_size, has_eol; in points) that follow on one baseline become one; a space where the gap is wide and none stands."""
    numbered = numbered_runs(fragments)
    parts = F.array_sort(F.collect_list(F.struct("stream_index", "apart", "text")))
    space = lambda t, p: F.when(p["apart"] & ~t.endswith(" ") & ~p["text"].startswith(" "), " ").otherwise("")
    first, last = lambda c: F.min_by(c, "stream_index"), lambda c: F.max_by(c, "stream_index")
    grouped = numbered.groupBy("doc_id", "page", "run").agg(
        F.min("stream_index").alias("stream_index"), F.aggregate(parts, F.lit(""), lambda t, p: F.concat(t, space(t, p), p["text"])).alias("text"), first("x").alias("x"), first("y").alias("y"), (last(F.col("x") + F.col("w")) - first("x")).alias("w"), first("font_size").alias("font_size"), last("has_eol").alias("has_eol")
    )
    return grouped.select(*fragments.columns)


def _line_machine():
    """Numbers lines: an item joins the first line of its column and source whose height it shares. Items come by y, so a column's lines are in order of y."""
    number, heights, numbers = 0, {}, {}

    def step(column: int, source: str, y: float, h: float) -> tuple[int]:
        nonlocal number
        own = heights.setdefault((column, source), [])
        at = bisect_left(own, y - max(LEAST_HEIGHT, BASELINE * h))
        if at == len(own):
            number += 1
            own.append(y)
            numbers.setdefault((column, source), []).append(number)
        return (numbers[column, source][at],)

    return step


def _spaced(parts: Column) -> Column:
    """Texts of items (x, stream_index, end, text) with one space between, three where a column's gap is."""
    gap = lambda p, i: F.when(i == 0, "").when(p["x"] - F.get(parts, i - 1)["end"] > COLUMN_GAP, "   ").otherwise(" ")
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(gap(p, i), p["text"])), "")
    return F.trim(F.replace(F.regexp_replace(F.regexp_replace(text, r"\s{3,}", "\x01"), r"\s+", " "), F.lit("\x01"), F.lit("   ")))


def numbered_lines(items: DataFrame) -> DataFrame:
    """items with line, the number of the line in its page."""
    return run_machine(items, ["doc_id", "page"], ["y", "x", "stream_index"], ["column", "source", "y", "h"], _line_machine, "line int")


def visual_lines(items: DataFrame) -> DataFrame:
    """Items (doc_id, page, column, source, stream_index, text, x, y, w, h) by line."""
    numbered = numbered_lines(items)
    parts = F.array_sort(F.collect_list(F.struct("x", "stream_index", (F.col("x") + F.col("w")).alias("end"), "text")))
    grouped = numbered.groupBy("doc_id", "page", "column", "source", "line").agg(
        F.min("y").alias("y"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.max("h").alias("h"), F.min("stream_index").alias("stream_index"), parts.alias("parts")
    )
    return grouped.select("doc_id", "page", "column", "source", "y", "x", "w", "h", "stream_index", _spaced(F.col("parts")).alias("text"))


def _wrap_machine():
    """Numbers paragraphs of lines that go on."""
    number, place, able, size, left, right, top, bottom = 0, None, False, 0.0, 0.0, 0.0, 0.0, 0.0

    def step(page: int, column: int, source: str, opens: bool, follows: bool, lower: bool, stops: bool, font: float, x: float, y: float, w: float, h: float, edge: float) -> tuple[int]:
        nonlocal number, place, able, size, left, right, top, bottom
        near = place == (page, column, source) and y - bottom < LEADING * (bottom - top) and abs(size - font) < FONTS
        if near and able and follows and (lower or right > edge - EDGE):
            left, right, able = min(left, x), max(right, x + w), not stops
        else:
            number, place, able, size, left, right, top = number + 1, (page, column, source), opens and not stops, font, x, x + w, y
        bottom = y + h
        return (number,)

    return step


def numbered_paragraphs(lines: DataFrame) -> DataFrame:
    """lines with paragraph, the number of the paragraph in its document.

    A bullet or text line without a stop at its end goes on in the next line of its column if it
    runs to the column's right edge, or if that starts in lower case and isn't dated.
    """
    text, end = F.col("text"), F.col("x") + F.col("w")
    flagged = lines.withColumns(
        {
            "opens": F.col("kind").isin("bullet", "text"),
            "follows": (F.col("kind") == "text") & ~text.rlike(DATE_RANGE),
            "lower": text.rlike("^[a-z]") & ~text.rlike(DATED),
            "stops": text.rlike("[.!?:;]$"),
            "edge": F.max(end).over(Window.partitionBy("doc_id", "page", "column", "source")),
        }
    )
    numbered = run_machine(flagged, ["doc_id"], LINE_ORDER, ["page", "column", "source", "opens", "follows", "lower", "stops", "font_size", "x", "y", "w", "h", "edge"], _wrap_machine, "paragraph int")
    return numbered.select(*lines.columns, "paragraph")


def merge_wrapped(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, column, source, kind, text, x, y, w, h, font_size, line_no) with continuations rejoined, numbered anew."""
    numbered, order, end = numbered_paragraphs(lines), LINE_ORDER, F.col("x") + F.col("w")
    at = F.struct(*order)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"])
    merged = {
        "text": F.array_join(texts, " "), "x": F.min("x"), "w": F.max(end) - F.min("x"), "h": F.max_by(F.col("y") + F.col("h"), at) - F.min_by("y", at), "line_no": F.first("paragraph"),
    }
    others = [F.min_by(c, at).alias(c) for c in lines.columns if c not in merged and c != "doc_id"]
    return numbered.groupBy("doc_id", "paragraph").agg(*[v.alias(k) for k, v in merged.items()], *others).select(*lines.columns)


def _row_machine():
    """Numbers rows: an item joins the open row if it shares the height of the row's first item."""
    number, page, height = 0, None, 0.0

    def step(on: int, y: float, h: float) -> tuple[int]:
        nonlocal number, page, height
        if on != page or abs(height - y) > max(LEAST_HEIGHT, BASELINE * h):
            number, page, height = number + 1, on, y
        return (number,)

    return step


def numbered_rows(items: DataFrame) -> DataFrame:
    """items with row_no, the row of a reader that sorts by position alone."""
    return run_machine(items, ["doc_id"], ["page", "y", "x", "stream_index"], ["page", "y", "h"], _row_machine, "row_no int")


def machine_rows(items: DataFrame) -> DataFrame:
    """(doc_id, row_no, text, mangled): what a reader sees that sorts by position alone; mangled rows mix columns."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "stream_index", F.trim("text").alias("text")))), lambda x: x["text"])
    return numbered_rows(items).groupBy("doc_id", "row_no").agg(F.regexp_replace(F.array_join(texts, " "), r"\s+", " ").alias("text"), (F.count_distinct("column") > 1).alias("mangled"))
