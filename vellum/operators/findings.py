"""Findings of the scoring rules over the lines, entries and fields of documents.

Every rule is a condition on the rows of a table; the rules of one table are tested in one
pass. cap_costs keeps a rule's findings of a document until their costs reach its cap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import bullet_strength, first_word, skeleton
from vellum.operators.layout import CONTACT_FIELDS, LOOSE, Layout, lost_contact, parse_findings

#: Weight of each category in the overall score, in order; fixed values.
WEIGHTS = {"parse": 25, "keywords": 25, "impact": 20, "structure": 15, "writing": 10, "contact": 5}
PROSE_SKIPPED = ("contact", "skills")


@dataclass(frozen=True)
class Model:
    """A corpus as tables: lines with sections and entries, entries, contact fields, years of experience, keyword matches; and, if known, its layout and each document's role."""

    lines: DataFrame
    entries: DataFrame
    contact: DataFrame
    years: DataFrame
    matches: DataFrame
    layout: Layout | None = None
    roles: DataFrame | None = None


#: The rules: category, cost, cap of all costs of the rule in a document, severity; a null cost or severity comes with the finding. Fixed values.
RULES = {
    "multi-column": ("parse", 30.0, None, "high"), "table": ("parse", 10.0, 30.0, "high"), "header-text": ("parse", None, None, None), "footer-text": ("parse", None, None, None),
    "textbox": ("parse", 12.0, 24.0, "high"), "image": ("parse", 5.0, 15.0, "low"), "vector-graphics": ("parse", 5.0, 15.0, "low"),
    "glyphs": ("parse", None, None, None), "symbol-bullets": ("parse", 3.0, None, "low"), "stream-order": ("parse", 8.0, None, "medium"), "file-size": ("parse", 5.0, None, "low"),
    "missing-keyword": ("keywords", None, None, None), "overused-keyword": ("keywords", 3.0, 9.0, "low"),
    "no-bullets": ("impact", 85.0, None, "high"), "weak-bullet": ("impact", None, None, None), "too-few-bullets": ("impact", None, None, "medium"),
    "missing-experience": ("structure", 30.0, None, "high"), "missing-education": ("structure", 15.0, None, "medium"), "missing-skills": ("structure", 15.0, None, "medium"),
    "nonstandard-heading": ("structure", 8.0, 24.0, "medium"), "unlabeled-summary": ("structure", 5.0, None, "low"), "undated-entry": ("structure", 6.0, 18.0, "medium"),
    "mixed-date-formats": ("structure", 5.0, None, "low"), "empty-entry": ("structure", 5.0, 10.0, "medium"), "incomplete-entry": ("structure", 3.0, 9.0, "low"),
    "section-order": ("structure", 4.0, None, "low"), "too-long": ("structure", 8.0, None, "medium"), "dense": ("structure", 4.0, None, "low"), "thin": ("structure", None, None, None),
    "objective-heading": ("structure", 3.0, None, "low"), "references-line": ("structure", 3.0, None, "low"),
    "weak-opener": ("writing", 8.0, 40.0, "high"), "generic-phrase": ("writing", 4.0, 24.0, "medium"), "filler": ("writing", 3.0, 15.0, "low"), "first-person": ("writing", 5.0, None, "low"),
    "passive": ("writing", 3.0, 9.0, "low"), "repeated-opener": ("writing", 4.0, 12.0, "low"), "identical-structure": ("writing", 8.0, None, "medium"), "overlong": ("writing", 2.0, 8.0, "low"),
    "objective-summary": ("writing", 5.0, None, "medium"), "summary-long": ("writing", 4.0, None, "low"),
    "missing-email": ("contact", 30.0, None, "high"), "missing-phone": ("contact", 20.0, None, "high"), "missing-location": ("contact", 15.0, None, "medium"),
    "missing-linkedin": ("contact", 12.0, None, "medium"), "missing-name": ("contact", 10.0, None, "medium"), "missing-portfolio": ("contact", 8.0, None, "medium"), "email-tone": ("contact", 5.0, None, "low"), "contact-sprawl": ("contact", 3.0, None, "low"),
}
#: A contact field that stands only in a header, footer or text box: its cost.
LOST_COST = {"email": 12.0, "phone": 8.0}
RULES |= {f"{f}-in-{s}": ("contact", LOST_COST.get(f, 4.0), None, "high" if LOST_COST.get(f, 4.0) >= 10 else "medium") for f in CONTACT_FIELDS for s in LOOSE}
#: What rules look for in a text, but for generic phrases.
SAID = {"filler": P.FILLER, "passive": P.PASSIVE, "references": P.REFERENCES, "person": P.FIRST_PERSON, "seeking": P.SEEKING}
#: Rules that share another's cap.
SHARED_CAP = {"vector-graphics": "image"}
#: Roles that are asked for a portfolio; fixed values.
TECH_ROLES = ("software-engineer", "frontend-engineer", "backend-engineer", "devops-sre", "data-scientist", "ux-designer")


def finding(when: Column, rule: str, *, line: str = "line_no", cost: Column | None = None, order: Column | None = None, severity: Column | None = None) -> Column:
    """A finding struct where the condition holds, else null. The rule's own cost and severity apply unless given; ties in a rule's cap go by order."""
    null = F.lit(None)
    one = F.struct(
        F.lit(rule).alias("rule_id"),
        F.col(line).cast("int").alias("line_no"),
        (null if cost is None else cost).cast("double").alias("cost"),
        (F.col(line) if order is None else order).cast("bigint").alias("ord"),
        (null if severity is None else severity).cast("string").alias("severity"),
    )
    return F.when(when, one)


def found(frame: DataFrame, *findings: Column, several: Column | None = None) -> DataFrame:
    """(doc_id, rule_id, line_no, cost, ord, severity): the findings of all rules in one pass over the rows of a table; several: an array of more."""
    each = [F.array_compact(F.array(*findings))] if findings else []
    every = F.concat(*each, *([] if several is None else [several]))
    return frame.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.*")


def with_rules(findings: DataFrame) -> DataFrame:
    """Adds category and cap, and the rule's own cost and severity where the finding has none. The rules are a few dozen rows."""
    rules = findings.sparkSession.createDataFrame([(k, *v) for k, v in RULES.items()], "rule_id string, category string, own_cost double, cap double, own_severity string")
    joined = findings.join(F.broadcast(rules), "rule_id")
    return joined.select("doc_id", "category", "rule_id", "line_no", F.coalesce("cost", "own_cost").alias("cost"), F.coalesce("severity", "own_severity").alias("severity"), "cap", "ord")


def cap_costs(findings: DataFrame) -> DataFrame:
    """Keeps a group's findings in order until the cap is reached; the last one kept is trimmed. Without a cap all stay."""
    group = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SHARED_CAP.items() for x in pair]), F.col("rule_id")), F.col("rule_id"))
    by = Window.partitionBy("doc_id", "category", group).orderBy("ord", "line_no")
    prior = F.coalesce(F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    marked = findings.withColumn("prior", prior).filter(F.col("cap").isNull() | (F.col("prior") < F.col("cap")))
    trimmed = F.when(F.col("cap").isNull(), F.col("cost")).otherwise(F.least("cost", F.col("cap") - F.col("prior")))
    return marked.withColumn("cost", F.round(trimmed, 1)).drop("prior", "cap")


def generic_phrases(text: Column) -> Column:
    """The numbers of the generic phrases that the text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), i) for i, (_, p) in enumerate(P.GENERIC)]))


def with_said(lines: DataFrame) -> DataFrame:
    """Lines -> also strength, weak, opener, shape, and said, a struct of the other patterns that rules look for. All of it follows from the text alone."""
    text = F.col("text")
    marks = {
        "strength": bullet_strength(text)["score"],
        "weak": F.trim(text).rlike(P.WEAK_START),
        "opener": first_word(text),
        "shape": skeleton(text),
    }
    said = {"generic": generic_phrases(text), **{k: text.rlike(p) for k, p in SAID.items()}}
    return lines.withColumns({**marks, "said": F.struct(*[v.alias(k) for k, v in said.items()])})


def _says(lines: DataFrame, name: str) -> Column:
    return F.col(f"said.{name}") if "said" in lines.columns else F.col("text").rlike(SAID[name])


def with_work(lines: DataFrame) -> DataFrame:
    """Lines -> also pos: the order of the lines that describe work, entries first, then bullets of experience without an entry; null for others.

    strength, weak, opener, shape and plain are computed below the window, once for all rules; of lines
    that with_said has marked, only plain. Lines that have them already, as those of a written model, stay as they are.
    """
    if "pos" in lines.columns:
        return lines
    marked = lines if "said" in lines.columns else with_said(lines).drop("said")
    attached = F.col("entry").isNotNull() & ~F.coalesce("header", F.lit(False)) & F.col("section").isin("experience", "projects", "volunteer") & F.col("kind").isin("bullet", "text")
    orphan = F.col("entry").isNull() & (F.col("section") == "experience") & (F.col("kind") == "bullet")
    rank = F.when(attached, 0).when(orphan, 1).otherwise(2)
    order = Window.partitionBy("doc_id").orderBy("rank", "entry", "line_no")
    return marked.withColumn("rank", rank).withColumn("plain", prose_condition()).withColumn("pos", F.when(F.col("rank") < 2, F.row_number().over(order))).drop("rank")


def work_bullets(lines: DataFrame) -> DataFrame:
    return with_work(lines).filter("pos is not null").select("doc_id", "line_no", "text", "words", "pos", "strength", "weak", "opener", "shape")


def line_findings(m: Model, only: tuple[str, ...] | None = None) -> DataFrame:
    """The rules that fire line by line; only: the names of those to test, all if None. What the others would need is not computed."""
    text = F.col("text")
    by_doc = Window.partitionBy("doc_id")
    rows = with_work(m.lines).withColumn("n_work", F.count("pos").over(by_doc)).withColumnRenamed("strength", "score")
    work, plain = F.col("pos").isNotNull(), F.col("plain")
    severity = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("score") + 1)
    phrase = lambda i: finding(F.lit(True), "generic-phrase", order=F.col("line_no") * 100 + i)
    held = F.col("said.generic") if "said" in rows.columns else F.col("generic") if "generic" in rows.columns else None
    generic, phrases = [], None
    if held is None:
        generic = [finding(plain & text.rlike(p), "generic-phrase", order=F.col("line_no") * 100 + i) for i, (_, p) in enumerate(P.GENERIC)]
    elif only is None or "generic-phrase" in only:
        phrases = F.transform(F.filter(held, lambda _: plain), phrase)
    rules = [
        ("weak-bullet", finding(work & (F.col("score") < 3), "weak-bullet", cost=F.round((3 - F.col("score")) / 3 * 100 / F.col("n_work"), 1), severity=severity)),
        ("weak-opener", finding(work & F.col("weak"), "weak-opener", order=F.col("pos"))),
        *[("generic-phrase", g) for g in generic],
        ("filler", finding(plain & _says(rows, "filler"), "filler")),
        ("passive", finding(plain & _says(rows, "passive"), "passive")),
        ("overlong", finding(work & (F.col("words") > 40), "overlong", order=F.col("pos"))),
        ("nonstandard-heading", finding(F.col("odd_heading"), "nonstandard-heading")),
    ]
    return found(rows, *[f for name, f in rules if only is None or name in only], several=phrases)


def known_contact(m: Model) -> DataFrame:
    """The contact fields of the body, else of headers, footers and text boxes; asks_portfolio: whether the document's role, or a target, does."""
    contact = m.contact
    if m.layout is not None:
        loose = lost_contact(m.layout).groupBy("doc_id").pivot("field", list(CONTACT_FIELDS)).agg(F.first("value"))
        both = contact.join(loose.select("doc_id", *[F.col(f).alias(f"lost_{f}") for f in CONTACT_FIELDS]), "doc_id", "left")
        contact = both.select(*[F.coalesce(c, f"lost_{c}").alias(c) if c in CONTACT_FIELDS else c for c in contact.columns])
    asked = m.matches.groupBy("doc_id").agg(F.max(F.col("term") == "git").alias("__git"))
    roles = m.roles if m.roles is not None else m.contact.select("doc_id", F.lit("general").alias("role"))
    with_role = contact.join(asked, "doc_id", "left").join(roles.select("doc_id", "role"), "doc_id", "left")
    return with_role.withColumn("asks_portfolio", F.coalesce(F.col("role").isin(*TECH_ROLES), F.lit(False)) | F.coalesce("__git", F.lit(False))).drop("__git", "role")


def lost_contact_findings(m: Model) -> DataFrame:
    """Contact fields that stand only where parsers don't look: in a header, footer or text box, with no copy in the body."""
    copies = m.lines.filter("source = 'body'").select("doc_id", F.lower("text").alias("said"))
    missing = m.contact.select("doc_id", *[F.col(f).isNull().alias(f"no_{f}") for f in CONTACT_FIELDS])
    lost = lost_contact(m.layout).join(missing, "doc_id")
    absent = reduce(lambda a, f: a | ((F.col("field") == f) & F.col(f"no_{f}")), CONTACT_FIELDS, F.lit(False))
    asked = lost.filter(absent)
    # The few lost fields meet the lines, not the lines the fields, so that a small side can be broadcast.
    copied = asked.select("doc_id", "field", "value").join(copies, "doc_id").filter(F.col("said").contains(F.lower("value"))).select("doc_id", "field").distinct()
    alone = asked.join(copied, ["doc_id", "field"], "left_anti")
    return found(alone, *[finding((F.col("field") == f) & (F.col("source") == s), f"{f}-in-{s}") for f in CONTACT_FIELDS for s in LOOSE])


def document_findings(m: Model) -> DataFrame:
    """The rules that fire once for a document, over one aggregate of its lines, entries and fields."""
    raw, opens, section = F.col("raw"), F.col("opens"), F.col("section")
    lines = with_work(m.lines)
    body = F.coalesce(~opens & F.col("section_no").isNotNull(), F.lit(False))
    first = lambda condition: F.min(F.when(condition, F.col("line_no")))
    summary = (section == "summary") & F.col("kind").isin("text", "bullet")
    strength = F.when(F.col("pos").isNotNull(), F.col("strength"))
    facts = lines.groupBy("doc_id").agg(
        first(raw.rlike(P.GLYPH_ISSUE)).alias("glyphs"), F.max(raw.rlike(P.GLYPH_ISSUE) & ((F.col("kind") == "contact") | (section == "contact"))).alias("glyph_contact"), first(F.col("bullet").isNotNull() & raw.rlike(P.SYMBOL_BULLET)).alias("symbols"),
        *[first(body & (section == s)).alias(s) for s in ("experience", "education", "skills")], first(opens & (section == "education")).alias("edu_line"),
        F.sum("words").alias("words"), F.count("*").alias("n_lines"), first(F.col("unlabelled")).alias("unlabelled"),
        first(opens & (section == "summary") & F.lower("raw").contains("objective")).alias("objective"), first(_says(lines, "references")).alias("references"),
        first(F.col("plain") & _says(lines, "person")).alias("person"), first(summary & _says(lines, "seeking")).alias("seeking"),
        F.sum(F.when(summary, F.col("words"))).alias("summary_words"), first(summary).alias("summary_line"),
        F.count("pos").alias("n_work"), F.try_divide(F.sum(strength), F.count("pos")).alias("strength"), F.count(F.when((F.col("kind") == "contact") & (section == "contact") & (F.col("source") == "body"), 1)).alias("n_contact"),
        first((F.col("kind") == "contact") & (section == "contact")).alias("contact_line"),
    )
    form = F.when(F.col("dates").rlike(r"\d{1,2}/\d{2,4}"), "numeric").when(F.col("dates").rlike(r"(?i)[a-z]{3,}\.?\s*'?\d{2,4}"), "month-year").when(F.col("dates").isNotNull(), "year")
    roles = m.entries.filter("section = 'experience'").groupBy("doc_id").agg(F.countDistinct(form).alias("forms"), F.min(F.when(F.col("dates").isNotNull(), F.col("header_line"))).alias("dated_line"))
    rows = facts.join(known_contact(m), "doc_id", "left").join(m.years, "doc_id", "left").join(roles, "doc_id", "left").withColumns({"line_no": F.lit(1), "pages": F.ceil(F.col("n_lines") / 55), "years": F.coalesce("years", F.lit(0))})
    gone = lambda c: F.col(c).isNull()
    there = lambda c: F.col(c).isNotNull()
    mean = F.round(F.col("strength") / 3 * 100)
    words = F.col("words")
    return found(
        rows,
        finding(there("glyphs"), "glyphs", cost=F.when(F.col("glyph_contact"), 8.0).otherwise(5.0), severity=F.when(F.col("glyph_contact"), "medium").otherwise("low"), line="glyphs"),
        finding(there("symbols"), "symbol-bullets", line="symbols"),
        finding(F.col("n_work") == 0, "no-bullets"),
        finding(F.col("n_work").between(1, 2), "too-few-bullets", cost=F.greatest(F.lit(0), mean - 60)),
        finding(gone("experience"), "missing-experience"),
        finding(gone("education"), "missing-education"),
        finding(gone("skills"), "missing-skills"),
        finding(there("unlabelled"), "unlabeled-summary", line="unlabelled"),
        finding(F.col("forms") > 1, "mixed-date-formats", line="dated_line"),
        finding((F.col("education") < F.col("experience")) & (F.col("years") >= 3), "section-order", line="edu_line"),
        finding(F.col("pages") > 2, "too-long"),
        finding((F.col("pages") <= 2) & (words > 950) & (F.col("years") < 8), "dense"),
        finding(words < 200, "thin", cost=F.when(words < 120, 12.0).otherwise(6.0), severity=F.when(words < 120, "medium").otherwise("low")),
        finding(there("objective"), "objective-heading", line="objective"),
        finding(there("references"), "references-line", line="references"),
        finding(there("person"), "first-person", line="person"),
        finding(there("seeking"), "objective-summary", line="seeking"),
        finding(F.col("summary_words") > 90, "summary-long", line="summary_line"),
        *[finding(gone(f), f"missing-{f}") for f in ("email", "phone", "location", "linkedin", "name")],
        finding(F.col("asks_portfolio") & gone("github") & gone("website"), "missing-portfolio"),
        finding(F.substring_index("email", "@", 1).rlike(P.EMAIL_TONE), "email-tone"),
        finding(F.col("n_contact") > 4, "contact-sprawl", line="contact_line"),
    )


def entry_findings(m: Model) -> DataFrame:
    work, at = F.col("section") == "experience", "header_line"
    return found(
        m.entries,
        finding((work | (F.col("section") == "education")) & F.col("start_year").isNull(), "undated-entry", line=at),
        finding(work & (F.col("n_bullets") == 0), "empty-entry", line=at),
        finding(work & (F.col("title").isNull() | F.col("org").isNull()), "incomplete-entry", line=at),
    )


def opener_findings(m: Model) -> DataFrame:
    """A first word that opens three bullets or more, at the third."""
    words = work_bullets(m.lines).filter("opener <> ''")
    own = F.array_sort(F.collect_list(F.struct("pos", "line_no", "weak")))
    by_word = words.groupBy("doc_id", "opener").agg(own.alias("own")).filter("size(own) >= 3").select("doc_id", F.col("own")[2]["line_no"].alias("line_no"), F.col("own")[0]["pos"].alias("pos"), F.col("own")[0]["weak"].alias("weak"))
    return found(by_word, finding(~F.col("weak"), "repeated-opener", order=F.col("pos")))


def skeleton_findings(m: Model) -> DataFrame:
    """One sentence skeleton with two features or more in 70% of five bullets or more."""
    shapes = work_bullets(m.lines).groupBy("doc_id", "shape").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("line_no", "pos").alias("line_no"))
    modal = shapes.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("shape", "n", "line_no"), F.struct(F.col("n"), -F.col("pos"))).alias("top")).select("doc_id", "total", "top.*")
    same = (F.col("total") >= 5) & (F.col("n") / F.col("total") >= 0.7) & (F.length(F.replace("shape", F.lit("x"), F.lit(""))) >= 2)
    return found(modal, finding(same, "identical-structure"))


def keyword_findings(m: Model) -> DataFrame:
    words = m.lines.groupBy("doc_id").agg(F.sum("words").alias("words"))
    by_doc = Window.partitionBy("doc_id")
    rows = m.matches.join(words, "doc_id").withColumns({"total": F.sum("weight").over(by_doc), "pos": F.row_number().over(by_doc.orderBy("term")), "line_no": F.lit(1)})
    most = F.greatest(F.lit(4), F.round(F.greatest(F.lit(50), F.col("words")) / 120))
    severity = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("weight"))
    return found(
        rows,
        finding(F.col("hits") == 0, "missing-keyword", cost=F.round(100 * F.col("weight") / F.col("total"), 1), order=F.col("pos"), severity=severity),
        finding(F.col("hits") > most, "overused-keyword", order=F.col("pos")),
    )


def prose_condition() -> Column:
    """Body and table lines of prose: bullets and text outside contact and skills."""
    return F.col("source").isin("body", "table") & F.col("kind").isin("bullet", "text") & ~F.col("section").isin(*PROSE_SKIPPED)


#: The scorers, by the table that each passes over once; a caller may replace or add some.
SCORERS: dict[str, Callable[[Model], DataFrame]] = {
    "lines": line_findings,
    "documents": document_findings,
    "entries": entry_findings,
    "openers": opener_findings,
    "skeletons": skeleton_findings,
    "keywords": keyword_findings,
}

#: Those that need positioned items, files and images.
LAYOUT_SCORERS: dict[str, Callable[[Model], DataFrame]] = {"layout": lambda m: parse_findings(m.layout, found, finding), "lost fields": lost_contact_findings}


def all_findings(m: Model, scorers: dict[str, Callable[[Model], DataFrame]] | None = None, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """Every scorer's findings, with capped costs. hold: what to do with each scorer's before the union, such as writing them to a table."""
    chosen = scorers or (SCORERS | (LAYOUT_SCORERS if m.layout is not None else {}))
    return cap_costs(with_rules(reduce(DataFrame.unionByName, [hold(f(m)) for f in chosen.values()])))
