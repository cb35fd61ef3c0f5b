"""The rewrite as hunks: against a plain walk over the derived documents, and on one small document with every kind of section."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators.findings import Model
from vellum.operators.hunks import rewrite_hunks
from vellum.operators.rewrite import rewritten_bullet
from vellum.plans.tables import corpus_model
from vellum.plans.terms import default_terms


@pytest.fixture(scope="module")
def hunks(spark, sf_dir):
    out = {}
    for r in catalog.q_rewrite_hunks(spark, sf_dir).orderBy("doc_id", "hunk_ord").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def _walk(lines, items, headline, bullet, person, first_skills):
    """(section, change, text, origins) of a document with contact, summary, skills, experience and education lines."""
    by_section, order = {}, []
    for r in lines:
        by_section.setdefault(r.section, []).append(r)
        if r.section not in order and r.section != "contact":
            order.append(r.section)
    if "section-order" in items:
        order.sort(key=["summary", "experience", "education", "skills"].index)
    order.sort(key=lambda s: s != "summary")
    out = [("contact", "same" if person else "insert")] if person or "contact-missing" in items else []
    for s in order:
        heads = [r for r in by_section[s] if r.opens]
        if heads:
            text = heads[0].raw if heads[0].odd_heading and "heading" not in items else s.capitalize()
            out.append((s, "same" if heads[0].raw.lower() == text.lower() else "modify", text, [heads[0].line_no]))
        else:
            out.append((s, "insert", s.capitalize(), []))
        rest = [r for r in by_section[s] if not r.opens]
        if s == "summary" and "summary" in items and headline:
            out.append((s, "modify", None, [r.line_no for r in rest]))
        elif s in ("experience", "education"):
            for e in sorted({r.entry for r in rest if r.entry is not None}):
                head = [r for r in rest if r.entry == e and r.header]
                if "dates" in items or len(head) > 1:
                    out.append((s, "same" if [headline[e]] == [r.text for r in head] else "modify", headline[e], [r.line_no for r in head]))
                else:
                    out += [(s, "same", r.text, [r.line_no]) for r in head]
                for r in (r for r in rest if r.entry == e and not r.header):
                    new = bullet[r.line_no] if "bullets" in items and s == "experience" else r.text
                    out.append((s, "same" if new == r.text else "modify", new, [r.line_no]))
            for r in (r for r in rest if r.entry is None):
                gone = "references" in items and "references available" in r.text.lower()
                out.append((s, "delete" if gone else "same", None if gone else r.text, [r.line_no]))
        elif s == "skills":
            out.append((s, "same" if [r.raw for r in rest] == [first_skills] else "modify", first_skills, [r.line_no for r in rest]))
        else:
            out += [(s, "same", r.text, [r.line_no]) for r in rest]
    return out


def test_derived_documents_against_a_walk(spark, sf_dir, hunks):
    m = corpus_model(spark, sf_dir)
    items, lines, headlines, bullets = {}, {}, {}, {}
    for r in catalog.q_plan(spark, sf_dir).filter("enabled").collect():
        items.setdefault(r.doc_id, set()).add(r.kind)
    for r in m.lines.orderBy("doc_id", "line_no").collect():
        lines.setdefault(r.doc_id, []).append(r)
    for r in catalog.q_headlines(spark, sf_dir).collect():
        headlines.setdefault(r.doc_id, {})[r.entry] = r.text
    for r in m.lines.filter("entry is not null and not header").select("doc_id", "line_no", rewritten_bullet(F.col("text")).alias("new")).collect():
        bullets.setdefault(r.doc_id, {})[r.line_no] = r.new
    people = {r.doc_id: r.name for r in m.contact.collect()}
    assert set(hunks) == set(lines)
    for doc, own in lines.items():
        first = next((h.text for h in hunks[doc] if h.section == "skills" and h.kind == "text" and h.origins), None)
        want = _walk(own, items.get(doc, set()), headlines.get(doc, {}), bullets.get(doc, {}), people[doc], first)
        got = [(h.section, h.change, h.text, [int(x) for x in h.origins.split(",") if x]) for h in hunks[doc] if not (h.section == "contact" and h.kind != "name") and not (h.section == "skills" and not h.origins)]
        same = [(g[:2] if len(w) == 2 else g[:2] + (None,) + g[3:] if w[2] is None else g) == w for g, w in zip(got, want)]
        assert len(got) == len(want) and all(same), doc
        named = Counter(int(x) for h in hunks[doc] for x in h.origins.split(",") if x)
        assert named == Counter(r.line_no for r in own)
    assert {"same", "modify", "insert"} <= {h.change for own in hunks.values() for h in own}


def test_log_counts_runs(spark, sf_dir, hunks):
    want = Counter()
    for doc, own in hunks.items():
        for before, h in zip([None, *own], own):
            goes_on = before is not None and before.change == h.change == "same" and before.section == h.section
            want[doc, h.section, h.change, "hunks"] += not goes_on
            want[doc, h.section, h.change, "lines"] += 1
    got = {}
    for r in catalog.q_rewrite_log(spark, sf_dir).collect():
        got[r.doc_id, r.section, r.change, "hunks"], got[r.doc_id, r.section, r.change, "lines"] = r.n_hunks, r.n_lines
    assert got == dict(want)


#: line_no, section, kind, text, opens, odd_heading, entry, header, source
SMALL = [
    (1, "contact", "name", "Ada Archer", False, False, None, None, "body"), (2, "contact", "text", "careful analyst", False, False, None, None, "body"), (3, "contact", "contact", "ada@mail.example", False, False, None, None, "body"),
    (4, "education", "heading", "EDUCATION", True, False, None, None, "body"), (5, "education", "entry", "B.S. Economics, 2008", False, False, 1, True, "body"),
    (6, "awards", "heading", "Wins", True, True, None, None, "body"), (7, "awards", "text", "First prize of the city,", False, False, None, None, "body"), (8, "awards", "text", "given twice", False, False, None, None, "body"),
    (9, "projects", "heading", "Projects", True, False, None, None, "body"), (10, "projects", "entry", "Atlas", False, False, 2, True, "body"), (11, "projects", "entry", "Mar 2019", False, False, 2, True, "body"), (12, "projects", "bullet", "Worked on maps", False, False, 2, False, "body"),
    (13, "interests", "heading", "Interests", True, False, None, None, "body"), (14, "interests", "text", "References available upon request", False, False, None, None, "body"),
    (15, "other", "text", "Page 1 of 2", False, False, None, None, "footer"), (16, "languages", "heading", "Languages", True, False, None, None, "body"),
]


def _small(spark, *on):
    rows = [(1, n, s, k, t, t, len(t.split()), o, odd, e, h, src) for n, s, k, t, o, odd, e, h, src in SMALL]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, section string, kind string, text string, raw string, words int, opens boolean, odd_heading boolean, entry int, header boolean, source string")
    entries = spark.createDataFrame([(1, 1, "education", "2008", "B.S. Economics", None), (1, 2, "projects", "Mar 2019", "Atlas", None)], "doc_id long, entry int, section string, dates string, title string, org string")
    contact = spark.createDataFrame([(1, "Ada Archer", "ada@mail.example", None, None, None, None, None, True)], "doc_id long, name string, email string, phone string, location string, linkedin string, github string, website string, asks_portfolio boolean")
    plan = spark.createDataFrame([(1, k, True) for k in on] + [(1, "summary", False)], "doc_id long, kind string, enabled boolean")
    years = spark.createDataFrame([], "doc_id long, years int")
    found = rewrite_hunks(Model(lines, entries, contact, years, None), contact, plan, default_terms(spark))
    return [(r.section, r.change, r.text, list(r.origins), r["item"]) for r in found.orderBy("hunk_ord").collect()]


def test_without_items_lines_stay(spark):
    got = _small(spark)
    assert [g[:4] for g in got] == [
        ("contact", "same", "Ada Archer", [1]), ("contact", "same", "careful analyst", [2]), ("contact", "same", "ada@mail.example", [3]),
        ("education", "same", "Education", [4]), ("education", "same", "B.S. Economics, 2008", [5]),
        ("awards", "same", "Wins", [6]), ("awards", "modify", "First prize of the city, given twice", [7, 8]),
        ("projects", "same", "Projects", [9]), ("projects", "modify", "Atlas — [[Employer]] | Mar 2019", [10, 11]), ("projects", "same", "Worked on maps", [12]),
        ("interests", "same", "Interests", [13]), ("interests", "same", "References available upon request", [14]),
        ("languages", "same", "Languages", [16]), ("other", "delete", None, [15]),
    ]
    assert all(g[4] is None for g in got)


def test_items_change_what_they_name(spark):
    got = _small(spark, "contact-missing", "heading", "section-order", "dates", "references", "bullets")
    assert [g[0] for g in got if g[1] != "delete" and g[2] in ("Projects", "Education", "Awards", "Interests", "Languages")] == ["projects", "education", "awards", "languages", "interests"]
    by_origin = {tuple(g[3]): g for g in got}
    assert by_origin[3,][2] == "[[City, ST]] · ada@mail.example · [[phone]] · [[linkedin.com/in/handle]] · [[portfolio or GitHub URL]]" and by_origin[3,][4] == "contact-missing"
    assert by_origin[6,] == ("awards", "modify", "Awards", [6], "heading")
    assert by_origin[5,][1:] == ("modify", "B.S. Economics | 2008", [5], "dates")
    assert by_origin[12,][1] == "modify" and by_origin[12,][4] == "bullets"
    assert by_origin[14,] == ("interests", "delete", None, [14], "references")
    assert not [g for g in got if g[0] == "skills"]

