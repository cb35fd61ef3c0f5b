"""Line breaking against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import wrap


def plain(text, size, most):
    width = lambda t: sum(wrap.WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else wrap.OTHER for c in t)
    rows, now = [], ""
    for word in text.split():
        longer = f"{now} {word}" if now else word
        if now and width(longer) > int(most * 1000 / size):
            rows.append(now)
            now = word
        else:
            now = longer
    return [*rows, now] if now else rows or [""]


def test_rows_equal_a_loop(spark):
    rng = random.Random(4)
    texts = ["", "   ", None, "one", "W" * 80, "a " * 3000, "W" * 80 + " i " + "W" * 80] + [" ".join("".join(rng.choices("iWm.é–x", k=rng.randrange(1, 12))) for _ in range(rng.randrange(60))) for _ in range(80)]
    lines = spark.createDataFrame([("d", i, t, 1) for i, t in enumerate(texts)], "doc_id string, line_no int, text string, row_no int")
    for size, most in ((10.0, 200.0), (11.5, 47.3), (8.0, 1.0)):
        got = {}
        for r in wrap.wrapped(lines, size, most).orderBy("line_no", "row_no").collect():
            got.setdefault(r.line_no, []).append(r.text)
        assert got == {i: plain(t or "", size, most) for i, t in enumerate(texts)}
    assert wrap.wrapped(lines.limit(0), 10.0, 100.0).count() == 0


@pytest.mark.parametrize("most", [0, 5, 17, 1000])
def test_breaks(most):
    widths = np.array([3, 4, 5, 30, 1, 1, 1, 1])
    starts, at, used = [], 0, None
    for i, w in enumerate(widths):
        if used is None or used + 2 + w > most:
            starts.append(i)
            used = w
        else:
            used += 2 + w
    assert wrap.breaks(widths, 2, most) == starts


def test_signs_of_an_export(spark):
    row = spark.createDataFrame([("▪ a ➢ b → c “d” ﬁ é 😀 • …",)], "t string")

    assert row.select(wrap.plain_signs(F.col("t"))).first()[0] == "- a -> b -> c “d”  é  • …"
