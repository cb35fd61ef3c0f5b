"""Column expressions over lines of text; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import patterns as P


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def removed(text: Column, *found: str, by: str = "") -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, by), found, text)


def normal_heading(text: Column) -> Column:
    """Lower-case, without closing punctuation; what is neither a-z nor & becomes a space."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"[_:|•·\-–—]+$", ""), r"[^a-z&\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def has_metric(text: Column, credit: bool = False) -> Column:
    """Whether a number that measures something is in the text; credit: placeholders count as one."""
    rest = removed(text, P.PLACEHOLDER, *P.NOT_METRIC)
    # Most lines have neither a digit nor a number word, and need no more tests.
    may = text.rlike(r"\d") | text.rlike(P.NUMBER_WORD)
    found = F.when(may, rest.rlike(r"\d") | (rest.rlike(P.NUMBER_WORD) & rest.rlike(P.COUNTABLE))).otherwise(False)
    return (text.rlike(P.PLACEHOLDER) | found) if credit else found


def first_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(text), r"^(\S*)", 1)), r"[^a-z]", "")


def strong_verb(text: Column) -> Column:
    """1 if the text opens with an action verb, else 0."""
    bare = F.regexp_replace(F.trim(text), r"^[^a-zA-Z]+", "")
    word = first_word(bare)
    strong = word.isin(*P.STRONG_IRREGULAR) | (word.rlike("ed$") & (F.length(word) > 3)) | word.rlike(P.BASE_VERB)
    return F.when((bare == "") | bare.rlike(P.WEAK_START), 0).when(strong, 1).otherwise(0)


def bullet_strength(text: Column, credit: bool = False) -> Column:
    """struct<verb, metric, outcome, score> of 0/1 marks and their sum."""
    bare = F.regexp_replace(text, P.PLACEHOLDER, " ")
    outcome = bare.rlike(P.OUTCOME) | (text.rlike(P.OUTCOME_PLACEHOLDER) if credit else F.lit(False))
    verb, metric, out = strong_verb(bare), has_metric(text, credit).cast("int"), outcome.cast("int")
    return F.struct(verb.alias("verb"), metric.alias("metric"), out.alias("outcome"), (verb + metric + out).alias("score"))


def skeleton(text: Column) -> Column:
    return F.concat(*[F.when(text.rlike(p), mark).otherwise("x") for p, mark in P.SKELETON])


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def band(score: Column) -> Column:
    return F.when(score < 50, "filtered").when(score < 70, "borderline").when(score < 85, "competitive").otherwise("strong")


def file_stem(name: Column) -> Column:
    """A safe stem of a file name: 40 lower-case letters, digits and dashes at most; `resume` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^a-zA-Z0-9]+", "-")
    return F.coalesce(F.nullif(F.left(F.lower(F.regexp_replace(bare, "^-|-$", "")), F.lit(40)), F.lit("")), F.lit("resume"))


def shown_glyphs(text: Column) -> Column:
    """Private-use glyphs as the replacement character, at most 60 characters."""
    return F.left(F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]", "�"), F.lit(60))


def normal_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s,$]", ""), "percent", "%"), r"\+$", "")


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def year_of(text: Column) -> Column:
    """The first year in a date: four digits, or two after an apostrophe (20..)."""
    full, short = F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.regexp_extract(text, r"'(\d{2})", 1)
    return F.when(full != "", full.cast("int")).when(short != "", short.cast("int") + 2000)


def in_unit(x: Column) -> Column:
    """The number within 0 and 1; 0 for none and for what is no finite number."""
    fit = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)
