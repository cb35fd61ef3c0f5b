"""Greedy line breaking by glyph widths, for exports that place text themselves.

A row takes words while they fit. With the words' widths summed up from the left, where a row ends is one
binary search, so a line costs a search for each row and not a step for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the characters from the space to the tilde in a sans-serif standard font, in thousandths of its size; fixed values. Others count as a digit does.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
OTHER = 556
#: Characters that an 8-bit export has no sign for become plainer ones: square and round bullets a dash, arrows an arrow of two signs; fixed values.
BULLETS, ARROWS = "▪●◦‣", "[→➢►]"
#: What an 8-bit export keeps: Latin-1 and common typographic marks; fixed values.
KEPT = r"[^\x{20}-\x{7E}\x{A0}-\x{FF}–—‘’“”•…‰€™]"


def plain_signs(text: Column) -> Column:
    """The text in signs that an 8-bit export has; others are left out."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, BULLETS, "-" * len(BULLETS)), ARROWS, "->"), KEPT, "")


def breaks(widths: np.ndarray, space: int, most: int) -> list[int]:
    """Where rows begin, by word: a row takes the words that fit, one at least."""
    upto = np.concatenate([[0], np.cumsum(widths + space)])
    starts, at = [], 0
    while at < len(widths):
        starts.append(at)
        # Words at..end take upto[end] - upto[at] less the last space.
        at = max(at + 1, int(np.searchsorted(upto, upto[at] + most + space, side="right")) - 1)
    return starts


def wrapped(lines: DataFrame, size: float, most: float) -> DataFrame:
    """(doc_id, line_no, row_no, text) of lines (doc_id, line_no, text): rows no wider than `most` at a font size, but for a word that alone is wider. A line without a word is one empty row; null counts as empty."""
    limit, table = int(most * 1000 / size), np.full(0x10000, OTHER, dtype=np.int64)
    table[32 : 32 + len(WIDTHS)] = WIDTHS
    own = lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.coalesce(plain_signs(F.col("text")), F.lit("")).alias("text"))

    def rows_of(text: str) -> list[str]:
        words = text.split()
        if not words:
            return [""]
        sizes = np.array([len(w) for w in words])
        glyphs = table[np.frombuffer("".join(words).encode("utf-16-le"), dtype=np.uint16)]
        widths = np.add.reduceat(glyphs, np.cumsum(sizes) - sizes)
        starts = breaks(widths, WIDTHS[0], limit)
        return [" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rows_of(t) for t in batch.column(2).to_pylist()]
            counts = [len(r) for r in rows]
            each = pa.array(np.repeat(np.arange(len(rows)), counts))
            numbers = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(numbers), pa.array([t for r in rows for t in r], pa.string())], ["doc_id", "line_no", "row_no", "text"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, line_no int, row_no int, text string")
