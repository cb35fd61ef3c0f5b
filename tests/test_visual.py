"""Folds over positioned items, and the rewriting rounds."""

import random

from pyspark.sql import functions as F

from vellum.operators import layout, lineage, machine_view, visual
from vellum.plans.terms import default_targets, default_terms
from vellum.plans.verify import rewrite_until

ITEM = "doc_id long, page int, column int, source string, stream_index int, text string, x double, y double, w double, h double"


def test_runs_join_on_a_baseline(spark):
    rows = [(1, 1, 0, "Sen", 10.0, 100.0, 15.0, 10.0, False), (1, 1, 1, "ior", 25.0, 100.0, 12.0, 10.0, False), (1, 1, 2, "Nurse", 40.0, 101.0, 30.0, 10.0, True), (1, 1, 3, "Next", 75.0, 101.0, 20.0, 10.0, False), (1, 1, 4, "far", 200.0, 101.0, 20.0, 10.0, False)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, stream_index int, text string, x double, y double, w double, font_size double, has_eol boolean")
    assert [r.text for r in visual.merge_runs(frame).orderBy("stream_index").collect()] == ["Senior Nurse", "Next", "far"]


def test_items_join_the_first_open_line(spark):
    rows = [(1, 1, 0, "body", 0, "Ada", 0.1, 0.100, 0.1, 0.012), (1, 1, 0, "body", 1, "Archer", 0.22, 0.103, 0.1, 0.012), (1, 1, 0, "body", 2, "2019", 0.7, 0.101, 0.1, 0.012), (1, 1, 1, "body", 3, "side", 0.8, 0.1, 0.1, 0.012), (1, 1, 0, "body", 4, "below", 0.1, 0.12, 0.1, 0.012)]
    got = visual.visual_lines(spark.createDataFrame(rows, ITEM)).orderBy("stream_index").collect()
    assert [r.text for r in got] == ["Ada Archer   2019", "side", "below"]


def test_wrapped_lines_rejoin(spark):
    def row(n, kind, text, y, w):
        return (1, 1, 0, "body", kind, text, 0.1, y, w, 0.012, 11.0, n)

    rows = [row(1, "bullet", "Built a long line that runs to the", 0.1, 0.8), row(2, "text", "Edge of the page.", 0.114, 0.3), row(3, "text", "Engineer 2019 – 2021", 0.128, 0.8), row(4, "bullet", "Short", 0.142, 0.1), row(5, "text", "goes on", 0.156, 0.1), row(6, "text", "New one", 0.17, 0.1)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, column int, source string, kind string, text string, x double, y double, w double, h double, font_size double, line_no int")
    got = [(r.line_no, r.text) for r in visual.merge_wrapped(frame).orderBy("line_no").collect()]
    assert got == [(1, "Built a long line that runs to the Edge of the page."), (2, "Engineer 2019 – 2021"), (3, "Short goes on"), (4, "New one")]


def test_machine_rows_mix_columns(spark):
    rows = [(1, 1, 0, "body", 0, "left", 0.1, 0.1, 0.2, 0.012), (1, 1, 1, "body", 1, "right", 0.6, 0.101, 0.2, 0.012), (1, 1, 0, "body", 2, "next", 0.1, 0.2, 0.2, 0.012)]
    got = [(r.text, r.mangled) for r in visual.machine_rows(spark.createDataFrame(rows, ITEM)).orderBy("row_no").collect()]
    assert got == [("left right", True), ("next", False)]


def test_rewriting_raises_scores_and_stops(spark):
    text = ["Ada Archer", "ada@mail.example", "Experience", "Data Analyst — Acme, Boston, MA | Jan 2019 – Present", "• Responsible for building reports.", "• Built 3 dashboards, saving 40 hours."]
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "doc_id long, line_no int, text string")
    after, history = rewrite_until(lines, default_terms(spark), default_targets(spark), 2024)
    got = {r.line_no: r.text for r in after.collect()}
    assert got[5] == "• Built reports used by [[number]] people, [[result: what improved and by how much]]." and got[6] == text[5]
    scores = [r.overall for r in history.orderBy("round").collect()]
    assert len(scores) == 2 and scores[1] >= scores[0]


def test_every_item_has_one_line_and_every_line_its_items(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for doc in (1, 2):
        for line in range(12):
            x = 50.0
            for piece in rng.choices(["Sen", "ior", "nurse", "on", "the", "ward"], k=rng.randrange(1, 5)):
                rows.append((doc, 1, n, piece, x, 100.0 + 14 * line, 20.0, 10.0, False))
                x, n = x + 20.0 + rng.choice([0.0, 3.0, 80.0]), n + 1
            rows[-1] = (*rows[-1][:-1], True)
    fragments = spark.createDataFrame(rows, "doc_id long, page int, stream_index int, text string, x double, y double, w double, font_size double, has_eol boolean")
    runs = visual.merge_runs(fragments).withColumns({"column": F.lit(0), "source": F.lit("body"), "x": F.col("x") / 600, "y": F.col("y") / 800, "w": F.col("w") / 600, "h": F.lit(0.012)})
    lines = visual.visual_lines(runs).withColumns({"kind": F.lit("text"), "font_size": F.lit(10.0), "line_no": F.col("stream_index")})
    paragraphs = visual.merge_wrapped(lines)
    to_line = lineage.composed(lineage.run_map(fragments), lineage.line_map(runs))
    whole = lineage.composed(to_line, lineage.paragraph_map(lines))
    assert sorted((r.doc_id, r.source_no) for r in whole.collect()) == sorted((r[0], r[2]) for r in rows)
    letters = {(r[0], r[2]): r[3] for r in rows}
    for mapped, merged, number in ((to_line, lines, "stream_index"), (whole, paragraphs, "line_no")):
        held = {(r.doc_id, r.target_no): r.source_nos for r in lineage.sources(mapped).collect()}
        texts = {(r.doc_id, r[number]): r.text.replace(" ", "") for r in merged.collect()}
        assert {k: sorted("".join(letters[k[0], i] for i in v)) for k, v in held.items()} == {k: sorted(t) for k, t in texts.items()}


def view_of(spark, items, kind):
    files = spark.createDataFrame([(1, kind, 10, 1)], "doc_id long, file_type string, file_size int, declared_columns int")
    frame = spark.createDataFrame([(1, *i) for i in items], "doc_id long, stream_index int, text string, page int, x double, y double, w double, h double, source string, table_id string, row int, col int")
    lay = layout.Layout(frame, spark.createDataFrame([], "doc_id long, page int, description string"), files)
    placed = machine_view.with_columns(frame)
    lines = machine_view.seen_lines(placed)
    return lay, lines, machine_view.machine_lines(lay, placed, lines)


def test_machine_view_of_two_columns(spark):
    items = [(2 * i + side, f"{'lr'[side]}{i}", 1, 0.6 if side else 0.06, 0.1 + i * 0.05, 0.3, 0.012, "body", None, None, None) for i in range(8) for side in (0, 1)]
    items += [(90, "a@b.example", 1, 0.06, 0.02, 0.3, 0.012, "header", None, None, None)]
    lay, lines, rows = view_of(spark, items, "pdf")
    assert [(r.text, r.mangled, len(r.line_nos)) for r in rows.orderBy("row_no").collect()] == [(f"l{i} r{i}", True, 2) for i in range(8)]
    states = machine_view.unread_lines(lines, rows).collect()
    text = {r.line_no: r.text for r in lines.collect()}
    assert [text[r.line_no] for r in states if r.state == "lost"] == ["a@b.example"]
    assert len([r for r in states if r.state == "scrambled"]) == 16
    # l0 ... l7 r0 ... r7 on the page, l0 r0 l1 r1 ... in the stream: eight lines and the last of the other column can stay.
    assert len([r for r in states if r.state == "moved"]) == 16 - 9
    assert {(r.word, r.n) for r in machine_view.missing_words(lines, rows).collect()} == {("a@b.example", 1)}
    assert tuple(machine_view.view_facts(lay, lines, rows).first()) == (1, 17, 8, 8, 1, 16, 7)


def test_machine_view_in_document_order(spark):
    cells = [(10 + i, f"• c{i}", 1, 0.1 + 0.2 * (i % 2), 0.3 + 0.1 * (i // 2), 0.1, 0.012, "table", "T", i // 2, i % 2) for i in range(4)]
    items = [(1, "before", 1, 0.1, 0.1, 0.5, 0.012, "body", None, None, None), *cells, (12 + 10, "after", 1, 0.1, 0.9, 0.5, 0.012, "body", None, None, None)]
    lay, lines, rows = view_of(spark, items, "docx")
    assert [(r.text, r.mangled) for r in rows.orderBy("row_no").collect()] == [("before", False), ("c0 c1", True), ("c2 c3", True), ("after", False)]
    assert machine_view.view_facts(lay, lines.limit(0), rows.limit(0)).first().n_rows == 0
