"""Scores of documents from their findings, and the improvement plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import band
from vellum.operators.findings import WEIGHTS, Model, work_bullets
from vellum.operators.keywords import match_percent
from vellum.operators.layout import CONTACT_FIELDS, LOOSE

MAX_SCORE = 99
#: Weights of the categories, in order, and factors for layout hazards of each screening engine; fixed values.
ENGINES = {
    "workday": ((30, 25, 15, 15, 10, 5), {"multi_column": 0.85, "tables": 0.9, "header_contact": 0.85, "images": 0.97, "text_boxes": 0.9}),
    "greenhouse": ((20, 20, 25, 15, 15, 5), {"multi_column": 0.95, "tables": 0.95, "header_contact": 0.95, "images": 1.0, "text_boxes": 0.95}),
    "lever": ((20, 25, 20, 15, 15, 5), {"multi_column": 0.92, "tables": 0.9, "header_contact": 0.95, "images": 1.0, "text_boxes": 0.92}),
    "taleo": ((35, 30, 10, 15, 5, 5), {"multi_column": 0.75, "tables": 0.8, "header_contact": 0.8, "images": 0.9, "text_boxes": 0.85}),
}
#: Plan items in the order in which they claim findings: kind, rules (category/rule), on by default.
PLAN = (
    ("layout", ("parse/multi-column", "parse/table", "parse/textbox", "parse/image", "parse/vector-graphics", "parse/glyphs", "parse/symbol-bullets", "parse/stream-order", "parse/file-size", "parse/footer-text/low"), True),
    ("contact", ("parse/header-text", "parse/footer-text/medium", "contact/contact-sprawl", *(f"contact/{f}-in-{s}" for f in CONTACT_FIELDS for s in LOOSE)), True),
    ("contact-missing", ("contact/missing-email", "contact/missing-phone", "contact/missing-location", "contact/missing-linkedin", "contact/missing-portfolio", "contact/missing-name"), True),
    ("heading", ("structure/nonstandard-heading", "structure/objective-heading", "structure/unlabeled-summary"), True),
    ("skills-section", ("structure/missing-skills",), True),
    ("other-sections", ("structure/missing-education", "structure/missing-experience"), False),
    ("section-order", ("structure/section-order",), True),
    ("dates", ("structure/mixed-date-formats", "structure/incomplete-entry", "structure/undated-entry"), True),
    ("references", ("structure/references-line",), True),
    ("bullets", ("impact/weak-bullet", "writing/weak-opener", "writing/generic-phrase", "writing/filler", "writing/passive", "writing/first-person", "writing/repeated-opener", "writing/identical-structure", "writing/overlong", "impact/too-few-bullets"), True),
    ("add-bullets", ("impact/no-bullets",), False),
    ("summary", ("writing/objective-summary", "writing/summary-long"), True),
    ("overused", ("keywords/overused-keyword",), True),
)


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def category_scores(m: Model, findings: DataFrame) -> DataFrame:
    """(doc_id, category, score, cost): a row for each document and category.

    100 less the costs, but for impact (the mean strength of bullets, 60 at most if there are
    fewer than three, 15 without any) and keywords (the match percent less overuse).
    """
    docs = m.lines.select("doc_id").distinct()
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, WEIGHTS))).alias("category"))
    costs = findings.groupBy("doc_id", "category").agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("rule_id") == "overused-keyword", F.col("cost")).otherwise(0)).alias("overuse"))
    strength = work_bullets(m.lines).groupBy("doc_id").agg((F.sum("strength") / (3.0 * F.count("*"))).alias("mean"), F.count("*").alias("n"))
    joined = grid.join(costs, ["doc_id", "category"], "left").join(strength, "doc_id", "left").join(match_percent(m.matches), "doc_id", "left")
    impact = F.when(F.col("mean").isNull(), 15).otherwise(F.least(_rounded(F.col("mean") * 100), F.when(F.col("n") < 3, 60).otherwise(100)))
    cost = F.coalesce("cost", F.lit(0.0))
    score = F.when(F.col("category") == "impact", impact).when(F.col("category") == "keywords", _rounded(F.coalesce("percent", F.lit(0)) - F.coalesce("overuse", F.lit(0.0)))).otherwise(_rounded(100 - cost))
    return joined.select("doc_id", "category", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"), F.round(cost, 1).alias("cost"))


def _weight(category: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.create_map(*[x for c, w in zip(WEIGHTS, weights) for x in (F.lit(c), F.lit(float(w)))]), category)


def overall_scores(scores: DataFrame) -> DataFrame:
    """(doc_id, raw_total, overall, band)."""
    raw = F.sum(F.col("score") * _weight(F.col("category"), tuple(WEIGHTS.values()))) / 100
    total = scores.groupBy("doc_id").agg(raw.alias("raw"))
    overall = F.least(F.lit(MAX_SCORE), _rounded(F.col("raw"))).cast("int")
    return total.select("doc_id", F.round("raw", 1).alias("raw_total"), overall.alias("overall"), band(overall).alias("band"))


def engine_scores(scores: DataFrame, hazards: DataFrame | None = None) -> DataFrame:
    """(doc_id, engine, score). hazards: (doc_id, one boolean column for each hazard); none for plain text."""
    engines = [F.struct(F.lit(e).alias("engine"), (F.col("score") * _weight(F.col("category"), w) / sum(w)).alias("part")) for e, (w, _) in ENGINES.items()]
    total = scores.select("doc_id", F.explode(F.array(*engines)).alias("e")).groupBy("doc_id", "e.engine").agg(F.sum("e.part").alias("score"))
    if hazards is not None:
        total = total.join(hazards, "doc_id", "left")
        for hazard in next(iter(ENGINES.values()))[1]:
            factor = F.element_at(F.create_map(*[x for e, (_, h) in ENGINES.items() for x in (F.lit(e), F.lit(h[hazard]))]), F.col("engine"))
            total = total.withColumn("score", F.when(F.coalesce(F.col(hazard), F.lit(False)), F.col("score") * factor).otherwise(F.col("score")))
    return total.select("doc_id", "engine", F.greatest(F.lit(0), F.least(F.lit(99), _rounded(F.round("score", 9)))).cast("int").alias("score"))


def plan_items(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, item, kind, gain, n_findings, enabled): what each item of the plan would gain, first claim first.

    Costs are scaled down where a category's costs exceed what its score lacks. Items that gain
    nothing are dropped, but for the layout.
    """
    claims = {rule: (i + 1, kind, on) for i, (kind, rules, on) in enumerate(PLAN) for rule in rules}
    pick = lambda k: F.element_at(F.create_map(*[x for r, c in claims.items() for x in (F.lit(r), F.lit(c[k]))]), F.concat_ws("/", "category", "rule_id", F.when(F.col("rule_id") == "footer-text", F.col("severity"))))
    claimed = findings.withColumns({"item": pick(0), "kind": pick(1), "enabled": pick(2)}).filter("item is not null")
    scale = scores.select("doc_id", "category", F.when(F.col("cost") > 0, F.least(F.lit(1.0), (100 - F.col("score")) / F.col("cost"))).otherwise(1.0).alias("scale"))
    gain = F.sum(F.col("cost") * F.col("scale") * _weight(F.col("category"), tuple(WEIGHTS.values())) / 100)
    items = claimed.join(scale, ["doc_id", "category"]).groupBy("doc_id", "item", "kind", "enabled").agg(gain.alias("gain"), F.count("*").alias("n_findings"))
    rounded = items.withColumn("gain", _rounded(F.round(F.col("gain") * 10, 6)) / 10)
    return rounded.filter("gain > 0 or kind = 'layout'").select("doc_id", "item", "kind", "gain", "n_findings", "enabled")


def projected_scores(overall: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, overall, projected): the score with the enabled items' gains."""
    gains = items.groupBy("doc_id").agg(F.sum(F.when(F.col("enabled"), F.col("gain")).otherwise(0.0)).alias("gain"))
    joined = overall.join(gains, "doc_id", "left")
    return joined.select("doc_id", "overall", F.least(F.lit(float(MAX_SCORE)), F.round(F.col("overall") + F.coalesce("gain", F.lit(0.0)), 1)).alias("projected"))


def weak_spots(scores: DataFrame, below: int = 90, most: int = 3) -> DataFrame:
    """(doc_id, category, lost, rank): the categories below a score that lose most of the total."""
    lost = (100 - F.col("score")) * _weight(F.col("category"), tuple(WEIGHTS.values())) / 100
    order = Window.partitionBy("doc_id").orderBy(F.desc("lost"), F.desc("category"))
    return scores.filter(F.col("score") < below).withColumn("lost", lost).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("doc_id", "category", "lost", "rank")
