from vellum import catalog
from vellum.operators.lines import classify_lines
from vellum.operators.sections import assign_sections, contact_fields
from vellum.plans import tables
from vellum.sources.text import with_fonts


def _made(spark, sf_dir, query):
    tables._corpus.cache_clear()
    query(spark, sf_dir)
    return {name for name in vars(tables.corpus(spark, sf_dir)) if not name.startswith("_")} - {"roles"}


def test_a_query_builds_only_the_tables_that_it_reads(spark, sf_dir):
    assert _made(spark, sf_dir, catalog.q_machine_rows) == {"layout"}
    assert _made(spark, sf_dir, catalog.q_supported) == {"text"}
    assert _made(spark, sf_dir, catalog.q_match_percent) == {"text"}
    assert _made(spark, sf_dir, catalog.q_layout) == {"text", "layout"}
    assert _made(spark, sf_dir, catalog.q_contact_missing) == {"text", "read", "contact"}
    assert _made(spark, sf_dir, catalog.q_filler) == {"text", "read"}


def test_one_rule_alone_finds_what_it_finds_among_all(spark, sf_dir):
    for rule in ("filler", "weak-opener", "generic-phrase"):
        of = lambda frame: sorted((r.doc_id, r.line_no, r.cost) for r in frame.collect())
        alone = of(tables.corpus(spark, sf_dir).line_rule(rule))
        assert alone and alone == of(tables.corpus_findings(spark, sf_dir).filter(f"rule_id = '{rule}'"))


def _lines(spark, *texts, doc_id=1):
    rows = [(doc_id, i, t) for i, t in enumerate(texts, 1)]
    return classify_lines(with_fonts(spark.createDataFrame(rows, "doc_id long, line_no int, text string")))


def test_more_than_six_words_before_any_heading_are_a_summary(spark):
    for line, section in (("Austin, TX · open to travel", "contact"), ("Austin, TX · open to ﬂexible travel", "summary")):
        found = assign_sections(_lines(spark, "Ada Archer", line, "Summary", "Analyst of retail data.")).filter("line_no = 2").first()
        assert found.section == section


def test_documents_without_a_field_keep_their_row(spark):
    for doc_id in (1, None):
        lines = assign_sections(_lines(spark, "Ada Archer", *["Experience"], *[f"careful work of kind {w}" for w in "abcdefg"], "write to ada@mail.example", doc_id=doc_id))
        row = contact_fields(lines.drop("section_no")).first()
        assert (row.doc_id, row.name, row.email, row.phone) == (doc_id, "Ada Archer", "ada@mail.example", None)
    bare = assign_sections(_lines(spark, *[f"careful work of kind {w}" for w in "abcdefghij"])).filter("line_no > 6 and section <> 'contact'")
    assert [r.email for r in contact_fields(bare).collect()] == [None] * (1 if bare.count() else 0)
