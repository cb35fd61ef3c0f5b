"""Target keywords of job descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.keywords import CASE_SENSITIVE, keyword_hits, named_candidates, top_targets
from vellum.sources.text import scan_lines

#: Lines that start the required and the optional part, and lines that name the job; fixed values.
REQUIRED = r"(?i)^(requirements|qualifications|what you.ll need|what we.re looking for|minimum qualifications|basic qualifications|must have|you have|about you|required skills|skills required)"
OPTIONAL = r"(?i)^(nice to have|preferred|bonus|preferred qualifications|plus|it.s a plus|nice-to-have)"
JOB = r"(?i)engineer|manager|analyst|designer|developer|scientist|specialist|director|lead|coordinator|associate|nurse|consultant|representative|architect|administrator"
PHRASE = r"(?i)(?:experience (?:with|in|using)|proficien(?:t|cy) (?:in|with)|knowledge of|familiarity with|expertise in|background in|skilled in|hands-on with)\s+([^.;\n]{3,80})"
REQUIRED_LINES, OPTIONAL_LINES = 25, 15


def zones(jds: DataFrame, id_col: str = "ctx_id") -> DataFrame:
    """(doc_id, line_no, text, required, optional, title): each line of a description, by the part it stands in."""
    lines = scan_lines(jds, id_col=id_col)
    text = F.col("text")
    first = lambda c: F.min(F.when(c, F.col("line_no")))
    starts = lines.groupBy("doc_id").agg(first(text.rlike(REQUIRED)).alias("r"), first(text.rlike(OPTIONAL)).alias("o"), first((F.length(text) < 80) & text.rlike(JOB)).alias("t"))
    at, r, o = F.col("line_no"), F.col("r"), F.col("o")
    end = F.when(o > r, o).otherwise(r + REQUIRED_LINES)
    no = lambda c: F.coalesce(c, F.lit(False))
    return lines.join(starts, "doc_id").select("doc_id", "line_no", "text", no((at > r) & (at < end)).alias("required"), no((at > o) & (at < o + OPTIONAL_LINES)).alias("optional"), no(at == F.col("t")).alias("title"))


def _weight(hits: Column) -> Column:
    """3 for what the title or the required part says, 1 for the optional part, 2 for what is said twice, 1 for soft skills, else 2."""
    return F.when(F.col("title") | F.col("required"), 3).when(F.col("optional"), 1).when(hits >= 2, 2).when(F.col("category") == "soft", 1).otherwise(2)


def extract_targets(jds: DataFrame, terms: DataFrame, most: int = 40) -> DataFrame:
    """jds (ctx_id, text) -> (ctx_id, term, category, weight, hits): dictionary terms, named products and phrases, the heaviest first.

    A term counts as required if it stands in the required part; the case-sensitive ones don't,
    as that part is read in lower case. A description without any keyword has no row.
    """
    lines = zones(jds)
    known = keyword_hits(lines.select("doc_id", "line_no", "text"), terms).join(lines.drop("text"), ["doc_id", "line_no"])
    special = F.col("term").isin(*CASE_SENSITIVE)
    flags = known.groupBy("doc_id", "term").agg(F.sum("hits").alias("hits"), F.max(F.col("required") & ~special).alias("required"), F.max(F.col("optional") & ~special).alias("optional"), F.max("title").alias("title"))
    listed = flags.join(terms.select("term", "category"), "term").select("doc_id", "term", "category", _weight(F.col("hits")).alias("weight"), "hits")
    names = terms.select(F.explode(F.concat(F.array("term"), "aliases")).alias("term")).distinct()
    lowered = lines.groupBy("doc_id").agg(
        F.lower(F.array_join(F.collect_list(F.when(F.col("required"), F.col("text"))), "\n")).alias("req"), F.lower(F.array_join(F.collect_list(F.when(F.col("optional"), F.col("text"))), "\n")).alias("opt")
    )
    texts = jds.select(F.col("ctx_id").alias("doc_id"), F.regexp_replace("text", "\r", "").alias("text"))
    named = named_candidates(texts).groupBy("doc_id", F.lower("candidate").alias("term")).agg(F.sum("n").alias("hits")).join(names, "term", "left_anti")
    pieces = F.flatten(
        F.transform(
            F.regexp_extract_all("text", F.lit(PHRASE), F.lit(1)),
            lambda p: F.slice(F.filter(F.transform(F.split(p, r",|\band\b|\bor\b|/"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^(the|a|an)\s+", "")), lambda x: F.length(x).between(3, 30)), 1, 4),
        )
    )
    phrases = texts.select("doc_id", F.explode(F.array_distinct(pieces)).alias("term")).filter(F.size(F.split("term", " ")) <= 3)
    fresh = phrases.join(names, "term", "left_anti").join(named.select("doc_id", "term"), ["doc_id", "term"], "left_anti").withColumn("hits", F.lit(1).cast("long"))

    def placed(frame: DataFrame, category: str) -> DataFrame:
        at = frame.join(lowered, "doc_id").withColumns({"category": F.lit(category), "title": F.lit(False), "required": F.col("req").contains(F.col("term"))})
        return at.withColumn("optional", F.col("opt").contains(F.col("term")) & ~F.col("required")).select("doc_id", "term", "category", _weight(F.col("hits")).alias("weight"), "hits")

    both = listed.unionByName(placed(named, "named")).unionByName(placed(fresh, "phrase")).withColumnRenamed("doc_id", "ctx_id")
    return top_targets(both, most).select("ctx_id", "term", "category", "weight", "hits")
