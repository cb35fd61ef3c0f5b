from pyspark.sql import functions as F

from vellum import catalog
from vellum.functions import patterns as P
from vellum.operators import texts
from vellum.operators.findings import with_said, with_work
from vellum.operators.gains import with_text
from vellum.operators.geometry import column_histogram
from vellum.operators.keywords import keyword_hits
from vellum.operators.lines import classify_lines, with_marks
from vellum.operators.sections import assign_sections, attach_entries, contact_fields, entry_table
from vellum.plans.tables import written
from vellum.plans.terms import default_terms
from vellum.sources.text import with_fonts

LINES = ["Ada Archer", "ada@mail.example · Austin, TX", "Experience", "Nurse — Acme, Austin, TX | Jan 2019 – Jun 2021", "• Responsible for various python import jobs.", "• Built docker builds by 12%.", "Education", "B.S. Economics, State University, 2008"]


def _lines(spark, copies=6):
    rows = [(d, i + 1, t) for d in range(copies) for i, t in enumerate([*LINES, f"• Wrote {d} reports in Java."])]
    return spark.createDataFrame([*rows, (99, 1, None), (99, 2, ""), (99, 3, "x" * 2_000)], "doc_id long, line_no int, text string")


def test_recurring_texts_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def size(text):
        seen.add(1)
        return None if text is None else len(text)

    rows = [(i, "often") for i in range(40)] + [(i, "rare") for i in range(3)] + [(1, None), (2, None), (3, None), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "k long, text string")
    found = texts.by_text(frame, texts.with_column("n", F.udf(size, "int")("text")), written).collect()
    assert sorted((r.k, r.text or "", -1 if r.n is None else r.n) for r in found) == sorted((k, t or "", -1 if t is None else len(t)) for k, t in rows)
    assert seen.value <= 1 + 3 + 4 + 1


def test_only_so_many_texts_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(texts, "MOST", 2)
    frame = spark.createDataFrame([(t,) for t, n in (("a", 64), ("b", 40), ("c", 9), ("d", 8)) for _ in range(n)], "text string")
    assert sorted(r.text for r in texts.recurring(frame, written).collect()) == ["a", "b"]
    monkeypatch.setattr(texts, "MOST", 0)
    assert texts.recurring(frame, written) is None
    assert texts.by_text(frame, texts.with_column("n", F.length("text")), written).count() == frame.count()


def _model(lines, hold):
    marked = texts.by_text(lines, lambda t: with_marks(with_fonts(t)), hold)
    read = written(attach_entries(written(assign_sections(classify_lines(marked)))))
    return with_work(texts.by_text(read, with_said, hold)), entry_table(read, hold)


def test_texts_that_recur_are_read_as_they_are_line_by_line(spark):
    lines = _lines(spark)
    (whole, entries), (plain, plain_entries) = _model(lines, written), _model(lines, None)
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(whole.select(*plain.columns)) == rows(plain) and rows(entries.select(*plain_entries.columns)) == rows(plain_entries)
    assert rows(keyword_hits(lines, default_terms(spark), written)) == rows(keyword_hits(lines, default_terms(spark)))
    new, work = F.concat("text", F.lit(" by 5%")), F.col("pos").isNotNull()
    assert rows(with_text(whole, new, work, written)) == rows(with_text(whole, F.when(work, new).otherwise(F.col("text"))))
    said = whole.filter(F.col("said.filler")).select("text").distinct().collect()
    assert said and all("various" in r.text for r in said) and P.FILLER


def test_sections_and_entries_need_one_order_of_the_lines(spark):
    marked = with_marks(with_fonts(_lines(spark)))
    plan = attach_entries(assign_sections(classify_lines(marked)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_contact_fields_of_texts_that_recur_are_as_line_by_line(spark):
    lines = written(attach_entries(assign_sections(classify_lines(with_marks(with_fonts(_lines(spark)))))))
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(contact_fields(lines, hold=written)) == rows(contact_fields(lines))


def test_only_lines_that_do_not_recur_are_rewritten_one_by_one(spark, sf_dir):
    for query in (catalog.q_rewritten, catalog.q_generic_phrases, catalog.q_rebuilt, catalog.q_claims):
        assert "LeftAnti, (text" in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_items_that_cover_the_same_bands_are_counted_once(spark):
    items = spark.createDataFrame([(1, 1, 0.125, 0.25, "body")] * 3 + [(1, 1, 0.25, 0.125, "body")], "doc_id int, page int, x double, w double, source string")
    found = column_histogram(items)
    assert {r.bin: r.n for r in found.collect()} == {b: 3 + (25 <= b) for b in range(12, 39)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")


def test_a_last_heading_without_a_known_name_is_text(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Ada Archer", "Skills", "Python, SQL, Docker", "MY JOURNEY"])], "doc_id long, line_no int, text string")
    found = attach_entries(assign_sections(classify_lines(with_fonts(lines))))
    assert [(r.kind, r.section) for r in found.orderBy("line_no").collect()][-1] == ("text", "skills")
