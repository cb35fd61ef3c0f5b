"""Every query that has an SQL twin gives its rows; the others are held to plain computations."""

import math
import re
from collections import Counter

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import fixes
from vellum.operators.findings import RULES, WEIGHTS
from vellum.operators.score import PLAN
from vellum.plans.corpus import CORPUS_SQL
from vellum.plans.rule_twin import PLANTED
from vellum.plans.tables import corpus_findings, corpus_scores

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same_rows(catalog.queries()[name](spark, sf_dir), duck, SQL[name])


#: Queries without an SQL twin, and the test that holds each to a plain computation.
OTHERWISE = {
    "q_line_marks": "test_line_marks", "q_plan": "test_plan_and_projection", "q_projected": "test_plan_and_projection", "q_findings": "test_findings_add_up", "q_roles": "test_roles", "q_kinds": "test_kinds",
    "q_placeholder_gains": "tests/test_gains.py", "q_rebuilt_changes": "tests/test_alignment.py", "q_nested_texts": "tests/test_tree.py", "q_line_fixes": "test_line_fixes",
    "q_rewrite_hunks": "tests/test_hunks.py", "q_rewrite_log": "tests/test_hunks.py",
    "q_rewritten": "tests/test_rules.py", "q_rebuilt": "tests/test_rules.py", "q_claims": "tests/test_rules.py", "q_headlines": "tests/test_rules.py", "q_summaries": "tests/test_rules.py",
}


def test_each_planted_rule_is_broken_and_kept(spark, sf_dir):
    """Of the documents planted for a rule some break it and some keep it."""
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    n = {r.rule_id: r.n for r in catalog.q_planted_rules(spark, sf_dir).groupBy("rule_id").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert set(n) == set(PLANTED) and all(0 < x < docs for x in n.values())


def test_every_query_is_held_by_something():
    assert set(catalog.queries()) - set(SQL) - set(OTHERWISE) == set()


@pytest.mark.parametrize("name", ["q_rewritten", "q_rebuilt", "q_claims", "q_headlines", "q_summaries", "q_nested_texts"])
def test_gives_a_row_for_many_documents(spark, sf_dir, name):
    rows = catalog.queries()[name](spark, sf_dir).toPandas()
    assert len(rows) > 30 and not rows.duplicated().all() and rows["text"].notna().all()


def _findings(spark, sf_dir):
    return [r.asDict() for r in corpus_findings(spark, sf_dir).collect()]


def test_line_marks(spark, sf_dir):
    want = {}
    for f in _findings(spark, sf_dir):
        if f["rule_id"] != "missing-keyword":
            rank, n, categories = want.get((f["doc_id"], f["line_no"]), (0, 0, set()))
            want[f["doc_id"], f["line_no"]] = max(rank, {"high": 3, "medium": 2}.get(f["severity"], 1)), n + 1, categories | {f["category"]}
    got = {(r.doc_id, r.line_no): (r["rank"], r.n, set(r.categories.split(","))) for r in catalog.q_line_marks(spark, sf_dir).collect()}
    assert got == want and got


def test_findings_add_up(spark, sf_dir):
    """The costs of a category are what its score lacks; no rule of a document costs more than its cap."""
    found, scores = _findings(spark, sf_dir), {(r.doc_id, r.category): r.score for r in catalog.q_category_scores(spark, sf_dir).collect()}
    costs, by_rule = Counter(), Counter()
    for f in found:
        costs[f["doc_id"], f["category"]] += f["cost"]
        by_rule[f["doc_id"], f["rule_id"]] += f["cost"]
    for (doc, category), score in scores.items():
        if category in ("parse", "structure", "writing", "contact"):
            assert score == max(0, math.floor(100 - costs[doc, category] + 0.5))
    assert all(RULES[rule][2] is None or cost <= RULES[rule][2] + 1e-9 for (_, rule), cost in by_rule.items())
    totals = {(r.category, r.rule_id): (r.n, r.cost) for r in catalog.q_findings(spark, sf_dir).collect()}
    assert totals == {k: (n, pytest.approx(sum(f["cost"] for f in found if (f["category"], f["rule_id"]) == k), abs=0.06)) for k, n in Counter((f["category"], f["rule_id"]) for f in found).items()}


def test_plan_and_projection(spark, sf_dir):
    scores = {(r.doc_id, r.category): (r.score, r.cost) for r in corpus_scores(spark, sf_dir).collect()}
    gains, numbers = Counter(), Counter()
    for f in _findings(spark, sf_dir):
        name = f"{f['category']}/{f['rule_id']}" + (f"/{f['severity']}" if f["rule_id"] == "footer-text" else "")
        item = next((i for i, (_, rules, _) in enumerate(PLAN, 1) if name in rules), None)
        if item:
            score, cost = scores[f["doc_id"], f["category"]]
            gains[f["doc_id"], item] += f["cost"] * (min(1.0, (100 - score) / cost) if cost > 0 else 1.0) * WEIGHTS[f["category"]] / 100
            numbers[f["doc_id"], item] += 1
    want = {k: (math.floor(round(g * 10, 6) + 0.5) / 10, numbers[k]) for k, g in gains.items()}
    want = {k: v for k, v in want.items() if v[0] > 0 or PLAN[k[1] - 1][0] == "layout"}
    got = {(r.doc_id, r["item"]): (r.gain, r.n_findings) for r in catalog.q_plan(spark, sf_dir).collect()}
    assert got == want and got
    overall = {r.doc_id: r.overall for r in catalog.q_overall(spark, sf_dir).collect()}
    projected = {r.doc_id: r.projected for r in catalog.q_projected(spark, sf_dir).collect()}
    for doc, now in overall.items():
        more = sum(g for (d, i), (g, _) in want.items() if d == doc and PLAN[i - 1][2])
        assert projected[doc] == pytest.approx(min(99.0, round(now + more, 1)), abs=0.051)


def test_line_fixes(spark, sf_dir):
    """Every fixable finding of the first forty lines of a document has its line's rewrite, the same for all of the line's."""
    lines, found = {}, Counter()
    for f in _findings(spark, sf_dir):
        if f["rule_id"] in fixes.FIXABLE:
            lines.setdefault(f["doc_id"], set()).add(f["line_no"])
            found[f["doc_id"], f["line_no"]] += 1
    got = catalog.q_line_fixes(spark, sf_dir).collect()
    by_line = {}
    for r in got:
        by_line.setdefault((r.doc_id, r.line_no), []).append(r.fix)
    assert Counter(d for d, _ in by_line) == {d: min(len(ls), fixes.MOST_LINES) for d, ls in lines.items()}
    assert all(len(set(v)) == 1 and len(v) == found[k] for k, v in by_line.items())
    assert len({(r.doc_id, r.finding) for r in got}) == len(got)


def test_roles(spark, sf_dir):
    from vellum.operators.keywords import keyword_hits
    from vellum.plans.tables import corpus_model
    from vellum.plans.terms import ROLES, default_terms

    m = corpus_model(spark, sf_dir)
    titles, held = {}, {}
    for r in m.entries.filter("section = 'experience' and title is not null").collect():
        titles.setdefault(r.doc_id, []).append(r.title)
    for r in keyword_hits(m.lines.filter("section in ('skills', 'summary')"), default_terms(spark)).collect():
        held.setdefault(r.doc_id, set()).add(r.term)
    got = {r.doc_id: (r.role, r.score) for r in catalog.q_roles(spark, sf_dir).collect()}
    assert set(got) == set(titles)
    for doc, names in titles.items():
        text, best = " | ".join(sorted(names)).lower(), ("", -1)
        for role, (words, weights) in ROLES.items():
            if role != "general":
                points = sum((6 if role == "software-engineer" else 10) if len(w) > 4 else 4 for w in words if re.search(rf"(?<![a-z]){w}(?![a-z])", text)) + sum(n for t, n in weights if t in held.get(doc, ()))
                best = max(best, (role, points), key=lambda x: x[1])
        assert got[doc] == (best[0] if best[1] >= 8 else "general", best[1])


def test_kinds(spark, sf_dir, duck):
    """Kinds that the corpus' own SQL can tell, and all lines once."""
    rows = {(r.kind, r.section): r.n for r in catalog.q_kinds(spark, sf_dir).collect()}
    by_kind = Counter()
    for (kind, _), n in rows.items():
        by_kind[kind] += n
    lines, bullets, heads, docs = duck.execute(f"SELECT count(*), count(CASE WHEN text LIKE '• %' OR text LIKE '➢ %' THEN 1 END), count(CASE WHEN text IN ('Experience', 'MY JOURNEY', 'Education', 'Skills', 'Summary', 'Objective') THEN 1 END), count(DISTINCT doc_id) FROM ({CORPUS_SQL})").fetchone()
    assert sum(rows.values()) == lines and by_kind["bullet"] == bullets and by_kind["heading"] == heads and by_kind["name"] == docs


def test_every_twin_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_entry_imports_and_lists_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "raw_total", "overall", "band"]
