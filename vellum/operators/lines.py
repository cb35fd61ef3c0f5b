"""What kind of line each line is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import count_words, normal_heading

#: Words of a heading at most; longer lines get no norm.
HEADING_WORDS = 5
NAME = r"^[A-Z][a-zA-Z'.-]+(\s[A-Z][a-zA-Z'.-]+){1,3}$"


def is_contact(text: Column) -> Column:
    bare = F.when(F.regexp_instr(text, F.lit(P.EMAIL)) > 0, F.regexp_replace(text, P.EMAIL, "")).otherwise(text)
    return text.rlike(P.EMAIL) | text.rlike(P.PHONE) | bare.rlike(P.URL)


def known_section(norm: Column) -> Column:
    """The section of a normalised heading by its exact name, or null."""
    found = F.when(F.lit(False), F.lit(""))
    for section, names in P.HEADINGS.items():
        found = found.when(norm.isin(*names), section)
    return found


def matched_section(norm: Column) -> Column:
    """By exact name, else by a name of six letters or more that starts or ends a heading not much longer; first name wins."""
    loose = []
    for section, names in P.HEADINGS.items():
        for name in (n for n in names if len(n) >= 6):
            fits = (F.length(norm) <= len(name) + 14) & (norm.startswith(f"{name} ") | norm.endswith(f" {name}"))
            loose.append(F.when(fits, section))
    return F.coalesce(known_section(norm), F.when(F.length(norm) > 6, F.coalesce(*loose)))


def _middle_size() -> Column:
    """The upper median of a document's font sizes, an element of the sorted sizes: the lower one of the negated sizes."""
    return F.expr("-(percentile_disc(0.5) within group (order by if(font_size > 0, -font_size, null)) over (partition by doc_id))")


def with_marks(lines: DataFrame) -> DataFrame:
    """Lines -> also raw, bullet, words, norm and marks, a struct of what kinds, and the headers of entries, ask of the text; text loses its bullet. All of it follows from the text alone.

    A line with a bullet is no other kind, and neither begins nor joins a header: its marks are false.
    """
    glyph = F.regexp_extract("raw", P.BULLET_GLYPH, 1)
    bullet = F.nullif(F.trim(glyph), F.lit(""))
    text, words, norm = F.col("text"), F.col("words"), F.col("norm")
    caps = (text == F.upper(text)) & text.rlike("[A-Z]") & ((words >= 2) | (F.length(F.regexp_replace(text, "[^A-Z]", "")) >= 6))
    marks = {
        "contact": is_contact(text),
        "known": (words <= HEADING_WORDS) & known_section(norm).isNotNull(),
        "name": words.between(2, 4) & text.rlike(NAME),
        "digit": text.rlike(r"\d"),
        "digits4": text.rlike(r"\d{4}"),
        "caps": caps,
        "bare": ~text.rlike(r":\s*\S") & ~text.rlike(r"[.;,]$") & (F.length(text) < 40),
        "strict_place": text.rlike(P.STRICT_LOCATION),
        "place": text.rlike(P.LOCATION),
        "range": text.rlike(P.DATE_RANGE),
        "single": text.rlike(P.SINGLE_DATE),
        "year": text.rlike(P.YEAR) & text.rlike(P.SEPARATOR),
        "title": text.rlike(P.TITLE),
        "degree": text.rlike(P.DEGREE),
        "school": text.rlike(P.SCHOOL),
        "ends": text.rlike(r"[.!]$"),
    }
    return (
        lines.withColumn("raw", text)
        .withColumn("bullet", bullet)
        .withColumn("text", F.when(F.col("bullet").isNotNull(), F.regexp_replace("raw", P.BULLET_GLYPH, "")).otherwise(F.col("raw")))
        .withColumn("words", count_words(text))
        .withColumn("norm", F.when(words <= HEADING_WORDS, normal_heading(text)))
        .withColumn("marks", F.struct(*[F.when(F.col("bullet").isNotNull(), False).otherwise(m).alias(k) for k, m in marks.items()]))
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines with fonts, marked or not -> also bullet (its glyph or null), raw, norm, words, marks and kind; the first rule that fits decides the kind."""
    words, mark = F.col("words"), lambda name: F.col(f"marks.{name}")
    by_doc, first = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines if "marks" in lines.columns else with_marks(lines)
    # One order of the lines serves the kinds, the sections and the entries.
    base = (
        marked.repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
        .withColumn("mid_size", _middle_size())
        .withColumn("max_size", F.max("font_size").over(by_doc))
        .withColumn("first_body", F.sum(F.when(F.col("source") == "body", 1).otherwise(0)).over(first.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    )
    in_table, digits4 = F.col("source") == "table", mark("digits4")
    big = F.col("font_size") >= F.col("mid_size") * 1.15
    kind = (
        F.when(F.col("bullet").isNotNull(), "bullet")
        .when(mark("contact"), "contact")
        .when(mark("known") & ~in_table, "heading")
        .when((F.col("source") == "body") & F.col("first_body") & mark("name"), "name")
        .when((F.col("page") == 1) & (F.col("font_size") == F.col("max_size")) & (words <= 4) & ~mark("digit") & (F.col("max_size") > F.col("mid_size") * 1.3), "name")
        .when(~in_table & (words <= HEADING_WORDS) & mark("bare") & (F.col("bold") | mark("caps") | (big & (words <= 3))) & ~digits4, "heading")
        .when(mark("strict_place") & (words <= 6) & ~digits4, "contact")
        .when((F.col("line_no") <= 8) & mark("place") & (words <= 4) & ~digits4, "contact")
        .otherwise("text")
    )
    return base.withColumn("kind", kind).drop("max_size", "mid_size", "first_body")
