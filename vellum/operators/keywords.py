"""Weighted keywords against lines, with implications between terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.operators.texts import Hold, recurring

#: Terms that count only when written the way the technology is written; fixed values.
CASE_SENSITIVE = {"go": ("Go", "Golang", "golang"), "r": ("R",), "c": ("C",)}
_KEY = r"[a-z0-9]+"
#: Dictionary forms up to this many are broadcast; more meet the tokens in a shuffle join.
BROADCAST_FORMS = 100_000


def _special(term: Column) -> Column:
    return term.isin(*CASE_SENSITIVE)


def form_pattern(form: Column, sensitive: Column) -> Column:
    """A whole-word pattern of one form: a space matches a dash too, a closing .js is optional, guards stand only beside word ends."""
    base = F.when(sensitive, form).otherwise(F.lower(form))
    escaped = F.regexp_replace(base, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    escaped = F.regexp_replace(F.regexp_replace(escaped, r"\\\.js$", r"(?:\\.js|js)?"), " ", r"[\\s-]")
    start = F.when(form.rlike("(?i)^[a-z0-9]"), "(?<![a-z0-9])").otherwise("")
    end = F.when(form.rlike("(?i)[a-z0-9+#]$"), "(?![a-z0-9+#])").otherwise("")
    return F.concat(start, escaped, end)


def term_forms(terms: DataFrame) -> DataFrame:
    """(term, form, key, pattern): one row for each form; key: a token that any text with the form holds."""
    special = F.lit(None).cast("array<string>")
    for term, forms in CASE_SENSITIVE.items():
        special = F.when(F.col("term") == term, F.array(*map(F.lit, forms))).otherwise(special)
    forms = terms.select("term", F.explode(F.coalesce(special, F.concat(F.array("term"), "aliases"))).alias("form"))
    pattern = form_pattern(F.col("form"), _special(F.col("term")))
    # Without their .js ending such forms match too, glued to it or not.
    keys = F.when(F.lower("form").rlike(r"\.js$"), F.array(F.regexp_extract(F.lower("form"), _KEY, 0), F.concat(F.regexp_extract(F.lower("form"), _KEY, 0), F.lit("js")))).otherwise(F.array(F.regexp_extract(F.lower("form"), _KEY, 0)))
    return forms.select("term", "form", pattern.alias("pattern"), F.explode(keys).alias("key"))


def term_patterns(terms: DataFrame) -> DataFrame:
    """(term, pattern): all forms of a term in one alternation."""
    forms = term_forms(terms).dropDuplicates(["term", "form"])
    joined = forms.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form", "pattern"))), lambda x: x["pattern"]), "|").alias("any"))
    return joined.select("term", F.when(_special(F.col("term")), F.concat(F.lit("(?:"), "any", F.lit(")"))).otherwise(F.concat(F.lit("(?i)(?:"), "any", F.lit(")"))).alias("pattern"))


def keyword_hits(lines: DataFrame, terms: DataFrame, hold: Hold | None = None) -> DataFrame:
    """(doc_id, line_no, term, hits) of every term in every line that holds it. hold: what to do with the tables of texts that recur, which are searched once; without it every line is searched."""
    texts = None if hold is None else recurring(lines, hold)
    if texts is None:
        return _searched(lines, terms)
    found = _searched(texts.select(F.col("text").alias("doc_id"), F.lit(0).alias("line_no"), "text"), terms).groupBy(F.col("doc_id").alias("text")).agg(F.collect_list(F.struct("term", "hits")).alias("found"))
    known = F.broadcast(hold(texts.join(found, "text", "left")))
    once = lines.select("doc_id", "line_no", "text").join(known, "text").select("doc_id", "line_no", F.inline("found"))
    return once.unionByName(_searched(lines.select("doc_id", "line_no", "text").join(known.select("text"), "text", "left_anti"), terms))


def _searched(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, line_no, term, hits), line by line.

    A line meets a term only through a token of one of its forms, so the regular expressions
    verify a few candidates instead of every pair of line and term. The three case-sensitive
    terms can match inside longer tokens, so every line verifies them.
    """
    body = lines.select("doc_id", "line_no", "text")
    patterns = term_patterns(terms)
    keys = term_forms(terms.filter(~_special(F.col("term")))).select("key", "term").distinct()
    small = keys.count() <= BROADCAST_FORMS
    tokens = body.select("*", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("key"))
    found = tokens.join(F.broadcast(keys) if small else keys, "key").drop("key")
    fixed = F.explode(F.array(*[F.when(F.col("text").contains(w), F.lit(t)) for t, w in (("go", "o"), ("r", "R"), ("c", "C"))])).alias("term")
    special = body.select("*", fixed).join(terms.select("term"), "term")
    both = found.unionByName(special.select(found.columns))
    verified = both.join(F.broadcast(patterns) if small else patterns, "term").withColumn("hits", F.size(F.expr("regexp_extract_all(text, pattern, 0)")))
    # A line that meets a term through two tokens is verified twice; only what holds is brought together, without its text.
    return verified.filter("hits > 0").select("doc_id", "line_no", "term", "hits").dropDuplicates(["doc_id", "line_no", "term"])


def implications(terms: DataFrame, depth: int = 3) -> DataFrame:
    """(term, implied, hops): the closure of the implications, each with its fewest hops, up to `depth`."""
    edges = terms.select("term", F.explode("implies").alias("implied"))
    now = edges.withColumn("hops", F.lit(1))
    found = now
    for hop in range(2, depth + 1):
        now = now.select("term", F.col("implied").alias("via")).join(edges.withColumnRenamed("term", "via"), "via").select("term", "implied", F.lit(hop).alias("hops"))
        found = found.unionByName(now)
    return found.groupBy("term", "implied").agg(F.min("hops").alias("hops"))


def match_targets(lines: DataFrame, terms: DataFrame, targets: DataFrame, hold: Hold | None = None) -> DataFrame:
    """(doc_id, term, weight, hits, n_lines, supported_by): a row for each document and target term.

    hits is 0 for a missing term; supported_by lists the document's terms that imply it. hold: as keyword_hits takes it.
    """
    hits = keyword_hits(lines, terms, hold).groupBy("doc_id", "term").agg(F.sum("hits").alias("hits"), F.count("*").alias("n_lines"))
    wanted = lines.select("doc_id").distinct().withColumn("t", F.explode(F.array(*[F.struct(F.lit(r.term).alias("term"), F.lit(r.weight).alias("weight")) for r in targets.collect()]))).select("doc_id", "t.*")
    implied = hits.join(implications(terms), "term").select("doc_id", F.col("implied").alias("term"), F.col("term").alias("by"))
    support = implied.groupBy("doc_id", "term").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("supported_by"))
    joined = wanted.join(hits, ["doc_id", "term"], "left").join(support, ["doc_id", "term"], "left")
    return joined.select("doc_id", "term", "weight", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(F.col("hits").isNull(), F.col("supported_by")).alias("supported_by"))


def match_percent(matches: DataFrame) -> DataFrame:
    """(doc_id, percent): the share of target weight that is present."""
    got, total = F.sum(F.when(F.col("hits") > 0, F.col("weight")).otherwise(0)), F.sum("weight")
    return matches.groupBy("doc_id").agg(F.round(100 * got / F.greatest(total, F.lit(1))).cast("int").alias("percent"))


def overused(matches: DataFrame, word_counts: DataFrame) -> DataFrame:
    """(doc_id, term, hits, most): terms said more often than the document's length allows."""
    most = F.greatest(F.lit(4), F.round(F.greatest(F.lit(50), F.col("words")) / 120)).cast("int")
    return matches.join(word_counts, "doc_id").withColumn("most", most).filter("hits > most").select("doc_id", "term", "hits", "most")


def infer_roles(titles: DataFrame, skills: DataFrame, terms: DataFrame, roles: dict, least: int = 8) -> DataFrame:
    """(doc_id, role, score): the role preset whose titles and terms fit best, the first of equals, `general` below the least score.

    titles: (doc_id, text) that name roles; skills: lines that name skills.
    """
    named = titles.groupBy("doc_id").agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " | ")).alias("text"))
    score = []
    for i, (role, (names, _)) in enumerate(roles.items()):
        if role == "general":
            continue
        weight = 6 if role == "software-engineer" else 10
        points = sum((F.when(F.col("text").rlike(rf"(?<![a-z]){n}(?![a-z])"), weight if len(n) > 4 else 4).otherwise(0) for n in names), F.lit(0))
        score.append(F.struct(F.lit(role).alias("role"), F.lit(i).alias("ord"), points.alias("points")))
    by_title = named.select("doc_id", F.explode(F.array(*score)).alias("s")).select("doc_id", "s.*")
    weights = [F.struct(F.lit(t).alias("term"), F.lit(r).alias("role"), F.lit(w).alias("w")) for r, (_, ts) in roles.items() for t, w in ts]
    hits = keyword_hits(skills, terms).select("doc_id", "term").distinct()
    by_skill = hits.withColumn("x", F.explode(F.filter(F.array(*weights), lambda x: x["term"] == F.col("term")))).groupBy("doc_id", "x.role").agg(F.sum("x.w").alias("more"))
    total = by_title.join(by_skill, ["doc_id", "role"], "left").withColumn("score", F.col("points") + F.coalesce("more", F.lit(0)))
    best = total.groupBy("doc_id").agg(F.max_by(F.struct("role", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    return best.select("doc_id", F.when(F.col("b.score") >= least, F.col("b.role")).otherwise("general").alias("role"), F.col("b.score").alias("score"))


def named_candidates(texts: DataFrame) -> DataFrame:
    """(doc_id, candidate, n): acronyms and CamelCase names in the column text, with their counts."""
    acronyms = F.regexp_extract_all("text", F.lit(P.ACRONYM), F.lit(0))
    names = F.regexp_extract_all("text", F.lit(P.CAMEL_CASE), F.lit(0))
    common = r"^(AND|OR|THE|US|USA|UK|EU|PM|AM|NYC|LA|SF|DC|ID|OK|NO|YES|TBD|PTO|K|M|B)$"
    found = texts.select("doc_id", F.explode(F.concat(acronyms, names)).alias("candidate")).filter(~F.col("candidate").rlike(common))
    return found.groupBy("doc_id", "candidate").agg(F.count("*").alias("n"))


def top_targets(candidates: DataFrame, most: int = 40) -> DataFrame:
    """The first `most` keywords of each context by weight, then hits; ties by term."""
    order = Window.partitionBy("ctx_id").orderBy(F.desc("weight"), F.desc("hits"), "term")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def preset_keywords(roles: dict, terms: DataFrame) -> DataFrame:
    """(role, term, weight, category, aliases): the keywords of each role preset as the dictionary names them, by term, else by alias; category `role` for those it lacks."""
    rows = [(role, i, t, w) for role, (_, ts) in roles.items() for i, (t, w) in enumerate(ts)]
    asked = terms.sparkSession.createDataFrame(rows, "role string, place int, asked string, weight int")
    alias = terms.select(F.explode("aliases").alias("asked"), F.struct("ord", "term", "category", "aliases").alias("by_alias")).groupBy("asked").agg(F.max("by_alias").alias("by_alias"))
    named = terms.select(F.col("term").alias("asked"), F.struct("ord", "term", "category", "aliases").alias("by_term"))
    found = asked.join(named, "asked", "left").join(alias, "asked", "left").withColumn("d", F.coalesce("by_term", "by_alias"))
    return found.select("role", "place", F.coalesce("d.term", "asked").alias("term"), "weight", F.coalesce("d.category", F.lit("role")).alias("category"), F.coalesce("d.aliases", F.array().cast("array<string>")).alias("aliases"))


def choose_context(docs: DataFrame, described: DataFrame, chosen: DataFrame, inferred: DataFrame, roles: dict) -> DataFrame:
    """(doc_id, kind, role): what a document is measured against.

    A description (doc_id, length, n_keywords) of over 60 characters with three keywords or more, else
    the role that its reader chose (doc_id, role; the last preset if unknown), else the inferred one.
    """
    last = list(roles)[-1]
    known = F.when(F.col("chosen").isin(*roles), F.col("chosen")).when(F.col("chosen").isNotNull(), F.lit(last))
    joined = docs.select("doc_id").join(described, "doc_id", "left").join(chosen.select("doc_id", F.col("role").alias("chosen")), "doc_id", "left").join(inferred.select("doc_id", F.col("role").alias("guess")), "doc_id", "left")
    by_text = (F.col("length") > 60) & (F.col("n_keywords") >= 3)
    kind = F.when(by_text, "description").when(known.isNotNull(), "role").otherwise("inferred")
    return joined.select("doc_id", kind.alias("kind"), F.when(~F.coalesce(by_text, F.lit(False)), F.coalesce(known, "guess", F.lit(last))).alias("role"))


def ordered_missing(matches: DataFrame) -> DataFrame:
    """(doc_id, term, weight, supported_by, rank): missing terms, the heaviest first, of those the supported ones first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.col("supported_by").isNull(), "term")
    return matches.filter("hits = 0").withColumn("rank", F.row_number().over(order)).select("doc_id", "term", "weight", "supported_by", "rank")
