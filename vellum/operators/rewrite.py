"""Rewriting lines: hunks, placeholders, claims and rule-based bullets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import bullet_strength, first_word, has_metric, normal_number, strong_verb, upper_first
from vellum.operators.keywords import keyword_hits
from vellum.operators.texts import Hold, by_text, with_column

#: Generic phrases that are said plainly instead, by the label of the phrase, and plain verbs that may take a phrase's place; fixed values.
PLAIN = {"spearheaded": "led", "leveraged": "used", "synergy": "worked with", "utilized": "used", "delve": "analyzed"}
#: Past forms that follow no rule, by base form; fixed values.
PAST = {
    "build": "built", "run": "ran", "write": "wrote", "lead": "led", "make": "made", "drive": "drove", "grow": "grew", "sell": "sold", "teach": "taught", "bring": "brought", "buy": "bought", "meet": "met", "hold": "held", "win": "won", "cut": "cut",
    "oversee": "oversaw", "keep": "kept", "get": "got", "give": "gave", "take": "took", "do": "did", "go": "went", "set": "set", "put": "put", "send": "sent", "spend": "spent", "begin": "began", "choose": "chose", "speak": "spoke", "understand": "understood",
}
#: The verb for what a bullet is about, and the hint at its scale, the first that fits; fixed values.
OBJECT_VERBS = (
    ("campaign|newsletter|email", "Produced"), ("event|webinar|conference", "Coordinated"), ("report|research|analysis|analyses", "Compiled"), ("dashboard|pipeline|model|tool|system|website|site|app", "Built"),
    ("account|client|customer|relationship|vendor", "Managed"), ("content|copy|blog|post|article|video", "Created"), ("meeting|note|minutes|documentation", "Documented"), ("data|entry|record|invoice|order", "Processed"),
    ("presentation|demo|training", "Delivered"), ("inventory|stock|shelves|shelf|register|sales", "Handled"), ("test|qa|bug|defect", "Tested"), ("schedule|calendar|travel", "Organized"), ("team|staff|volunteer|intern", "Coordinated"),
)
SCALE_HINTS = (
    ("account", " across [[number]] accounts"), ("campaign|newsletter|email", " ([[number]] campaigns per month to [[audience size]] recipients)"), ("event|webinar", " for [[number]] events with [[attendance]] attendees"),
    ("report|dashboard", " used by [[number]] people"), ("customer|client|patient|student", " for [[number]] customers per week"), ("website|blog|content|post", " ([[number]] pieces per month)"),
    ("data|record|entry|invoice", " ([[volume]] records per week)"), ("team|engineer|people|staff", " across a team of [[number]]"), ("sales|revenue|store|register", " ([[amount]] in sales)"),
)
#: Filler that a rewrite leaves out, and whom a weak opener helped; fixed values.
CUT = P.ascii_edges(r"(?i)\b(various|numerous|a variety of|a wide range of|a range of|several|as needed|as required|etc\.?|and more|and other duties|other tasks|day[- ]to[- ]day|on a daily basis|when necessary|as assigned|miscellaneous)\b")
HELPED = P.ascii_edges(r"(?i)^(?:the\s+)?(?:team|manager|managers|department|staff|clients?|customers?|leadership|engineers?|colleagues)\s+(?:with|on|in|by)\s+")
OUTCOME_ASKED = r"(?i)\[\[(result|outcome|impact|improv)"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _first_fit(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first pattern that the text holds, or null."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){pattern}"), value) for pattern, value in table])


def past_tense(word: Column) -> Column:
    """A gerund's past tense: irregular ones by their base form, with or without a final e, then -ying to -ied, -e to -ed, or -ed. Other words stay."""
    stem = F.regexp_replace(F.lower(word), "ing$", "")
    known = F.coalesce(_lookup(PAST, stem), _lookup(PAST, F.concat(stem, F.lit("e"))))
    regular = F.when(stem.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(stem, "y$", ""), F.lit("ied"))).when(stem.rlike("e$"), F.concat(stem, F.lit("d"))).otherwise(F.concat(stem, F.lit("ed")))
    return F.when(F.lower(word).rlike("^.{2,}ing$"), F.coalesce(known, regular)).otherwise(word)


def lower_first(text: Column) -> Column:
    """The first letter in lower case, if a lower-case letter follows it."""
    return F.when(text.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it: the steps of a rewrite would else double with each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scrubbed(text: Column, drop: bool = False) -> Column:
    """Generic phrases said plainly, in the case of the phrase; drop: those without a plain verb are left out."""
    for label, pattern in P.GENERIC:
        plain, bare = PLAIN.get(label), pattern.removeprefix("(?i)")
        if plain:
            text = F.regexp_replace(F.regexp_replace(text, rf"(?=[A-Z])(?i:{bare})", plain.capitalize()), pattern, plain)
        elif drop:
            text = F.regexp_replace(text, rf"(?i)(?:{bare})\s*,?\s*", "")
    return text


def _opened(text: Column) -> Column:
    """The text with a strong verb first: a gerund in the past, or a verb for what the text is about."""

    def begun(first: Column) -> Column:
        rest = F.substring(text, F.length(first) + 1, F.length(text))
        verb = F.coalesce(_first_fit(text, OBJECT_VERBS), F.lit("Delivered"))
        return F.when(first.rlike("(?i)ing$"), F.concat(_with(past_tense(first), upper_first), rest)).otherwise(F.concat(verb, F.lit(" "), lower_first(text)))

    return _with(F.substring_index(text, " ", 1), begun)


def _led(bare: Column) -> Column:
    """The text without a weak opener, a strong verb first."""
    after = F.regexp_replace(F.trim(F.regexp_replace(bare, P.WEAK_START, "")), r"(?i)^(the|a|an|for|with|in|on|of|to)\s+", "")
    object_ = F.regexp_replace(F.regexp_replace(after, HELPED, ""), r"(?i)^(the|a|an)\s+", "")
    strong = lambda t: _with(first_word(t), lambda w: w.isin(*P.STRONG_IRREGULAR) | w.rlike("ed$")) & ~F.substring_index(t, " ", 1).rlike("(?i)ing$")
    opened = _with(object_, lambda t: F.when(strong(t), t).otherwise(_opened(t)))
    return F.when(bare.rlike(P.WEAK_START), opened).when(strong_verb(bare) == 0, _opened(bare)).otherwise(bare)


def rewritten_bullet(text: Column) -> Column:
    """A weak bullet by rule: opener and filler cut, a strong verb first, phrases said plainly, pronouns dropped, placeholders for what is missing, one full stop. No fact is added."""
    led = _with(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"[.;]+$", ""), _led)
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(led, CUT, ""), r"\s{2,}", " "), r"\s+([,.])", "$1"))
    own = F.trim(F.regexp_replace(F.regexp_replace(scrubbed(clean, drop=True), P.ascii_edges(r"\b(I|my|our|we)\b\s*"), ""), r"\s{2,}", " "))
    scaled = lambda t: F.when(has_metric(t, credit=True), t).otherwise(F.concat(t, F.coalesce(_first_fit(t, SCALE_HINTS), F.lit(" ([[quantity or scale]])"))))
    whole = lambda t: F.when(t.rlike(P.OUTCOME) | t.rlike(OUTCOME_ASKED), t).otherwise(F.concat(t, F.lit(", [[result: what improved and by how much]]")))
    said = _with(_with(_with(own, upper_first), scaled), whole)
    return F.concat(F.regexp_replace(F.regexp_replace(said, r"\s{2,}", " "), r",\s*,", ","), F.lit("."))


#: What stands in for a placeholder when its gain is estimated, the first hint that fits; fixed values.
STAND_INS = (
    ("email", "name@example.com"), ("phone", "(555) 000-0000"), ("linkedin", "linkedin.com/in/handle"), ("city|location", "City, ST"), ("url|portfolio|github", "github.com/handle"),
    ("mon yyyy|dates?", "Jan 2020 – Dec 2022"), ("name", "Full Name"), ("result|outcome|improv", "cutting turnaround 30%"),
)


def stand_in(hint: Column) -> Column:
    return F.coalesce(_first_fit(hint, STAND_INS), F.lit("10"))


#: A number with its unit, but not the space after it.
NUMBER = r"(?i)(?:\$\s?)?\d[\d,]*(?:\.\d+)?(?:\s?(?:%|percent|million|billion|thousand|[kmbx](?![a-z])))?\+?"
#: Categories of terms that a rewrite may name though the original doesn't.
FREE_CATEGORIES = ("soft", "method", "business", "leadership", "skill")


def allowed_numbers(originals: DataFrame, hold: Hold | None = None) -> DataFrame:
    """(doc_id, numbers): the distinct numbers of each document, in one form. hold: as checked_claims takes it."""
    each = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), lambda n: normal_number(n))
    read = by_text(originals.select("doc_id", "text"), with_column("numbers", each), hold)
    return read.select("doc_id", F.explode("numbers").alias("n")).groupBy("doc_id").agg(F.collect_set("n").alias("numbers"))


def checked_claims(rewrites: DataFrame, originals: DataFrame, terms: DataFrame, hold: Hold | None = None) -> DataFrame:
    """(doc_id, line_no, text, removed, rejected): rewrites with every number that the original lacks replaced by a placeholder.

    Years and what stands in placeholders are left. rejected: the terms that the rewrite names and the
    original doesn't, of categories that must not be made up; a caller keeps the original line then.
    hold: what to do with the tables of texts that recur, which are read once; without it every line is.
    """
    joined = rewrites.select("doc_id", "line_no", "text").join(allowed_numbers(originals, hold), "doc_id", "left")
    # A text is cut at its placeholders; their own digits are no claims.
    pieces = F.split("text", P.PLACEHOLDER, -1)
    marks = F.concat(F.regexp_extract_all("text", F.lit(P.PLACEHOLDER), F.lit(0)), F.array(F.lit("")))
    numbers = lambda t: F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    made_up = lambda n: ~n.rlike(r"^(19|20)\d{2}$") & ~F.array_contains(F.coalesce("numbers", F.array().cast("array<string>")), normal_number(n))
    gaps = lambda t: F.split(t, NUMBER, -1)
    clean = lambda t: F.array_join(F.zip_with(gaps(t), F.transform(numbers(t), lambda n: F.when(made_up(n), "[[number]]").otherwise(n)), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    text = F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(clean(p), m)), "")
    removed = F.size(F.filter(F.flatten(F.transform(pieces, numbers)), made_up))
    checked = joined.select("doc_id", "line_no", text.alias("text"), removed.alias("removed"))
    hard = terms.filter(~F.col("category").isin(*FREE_CATEGORIES))
    named = keyword_hits(rewrites.select("doc_id", "line_no", F.regexp_replace("text", P.PLACEHOLDER, "").alias("text")), hard, hold)
    held = keyword_hits(originals, hard, hold).select("doc_id", "term").distinct()
    made = named.join(held, ["doc_id", "term"], "left_anti").groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_set("term")).alias("rejected"))
    return checked.join(made, ["doc_id", "line_no"], "left").withColumn("rejected", F.coalesce("rejected", F.array().cast("array<string>")))


def quoted_evidence(claims: DataFrame, originals: DataFrame) -> DataFrame:
    """claims (doc_id, term, evidence) whose evidence, of six letters or more, is a quote of the document; case and spacing don't count."""
    flat = lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    texts = originals.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("__whole"))
    said = flat(F.col("evidence"))
    return claims.join(texts, "doc_id").filter((F.length(said) >= 6) & flat(F.col("__whole")).contains(said)).drop("__whole")


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: What parts the two dates of a range.
TO = r"(?i)\s*(?:–|—|-|−|to|until|through|~)\s*"
NO_DATES = "[[Mon YYYY – Mon YYYY]]"


def normal_date(text: Column) -> Column:
    """One date as Present, Season YYYY, Mon YYYY or YYYY; what is no date stays."""
    t = F.trim(text)
    season, named, digits = r"(?i)(spring|summer|fall|autumn|winter)\s+((?:19|20)\d{2})", r"(?i)([a-z]{3,})\.?\s*'?(\d{2,4})", r"(\d{1,2})/(\d{2,4})"
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    month = F.element_at(F.create_map(*[x for m in MONTHS for x in (F.lit(m.lower()), F.lit(m))]), F.lower(F.left(part(named, 1), F.lit(3))))
    number = F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(F.nullif(part(digits, 1), F.lit("")).cast("int"), F.lit(1))))
    return (
        F.when(t.rlike(P.OPEN_END), "Present")
        .when(t.rlike(season), F.concat(upper_first(F.lower(part(season, 1))), F.lit(" "), part(season, 2)))
        .when(t.rlike(named), F.concat_ws(" ", month, year(part(named, 2))))
        .when(t.rlike(digits), F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), number), F.lit(" "), year(part(digits, 2))))
        .when(t.rlike(r"(19|20)\d{2}"), F.regexp_extract(t, r"((?:19|20)\d{2})", 1))
        .otherwise(t)
    )


def normal_dates(dates: Column) -> Column:
    """A date or a range in one form; a placeholder for none."""
    parts = F.filter(F.split(dates, TO), lambda p: p != "")
    both = F.concat(normal_date(F.get(parts, F.lit(0))), F.lit(" – "), normal_date(F.element_at(parts, -1)))
    return F.when(F.coalesce(dates, F.lit("")) == "", NO_DATES).when(F.size(parts) >= 2, both).otherwise(normal_date(F.coalesce(F.get(parts, F.lit(0)), dates)))


def headlines(entries: DataFrame) -> DataFrame:
    """(doc_id, entry, text): each entry's header in one form, with placeholders for what it lacks."""
    edu = F.col("section") == "education"
    work = F.concat(F.coalesce("title", F.lit("[[Job title]]")), F.lit(" — "), F.coalesce("org", F.lit("[[Employer]]")))
    school = F.coalesce(F.nullif(F.concat_ws(" — ", "title", "org"), F.lit("")), F.lit("[[Degree — School]]"))
    return entries.select("doc_id", "entry", F.concat_ws(" | ", F.when(edu, school).otherwise(work), normal_dates(F.col("dates"))).alias("text"))


def _listed(items: Column) -> Column:
    """One, two and three; null for none."""
    n = F.size(items)
    return F.when(n > 1, F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1))).when(n == 1, F.get(items, F.lit(0)))


def summaries(lines: DataFrame, entries: DataFrame, years: DataFrame) -> DataFrame:
    """(doc_id, text): one line of fact for each document, from its first role, years, employers and skills, if it has a role."""
    roles = entries.filter("section = 'experience'").groupBy("doc_id").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("entry"))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("org").isNotNull(), F.struct("entry", "org")))).alias("orgs"))
    parts = F.filter(F.transform(F.split("text", r"[,|•·]"), lambda x: F.trim(x)), lambda x: F.length(x).between(2, 29))
    skills = lines.filter("section = 'skills' and kind <> 'heading'").select("doc_id", "line_no", parts.alias("parts")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "parts"))), lambda x: x["parts"])).alias("skills"))
    joined = roles.join(skills, "doc_id", "left").join(years, "doc_id", "left")
    orgs = _listed(F.slice(F.transform("orgs", lambda x: x["org"]), 1, 3))
    text = F.concat(
        F.coalesce("title", F.lit("[[Job title]]")),
        F.when(F.col("years") >= 1, F.concat(F.lit(" with "), F.col("years").cast("string"), F.lit("+ years"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" across "), orgs), F.lit("")),
        F.coalesce(F.concat(F.lit("; hands-on with "), _listed(F.slice("skills", 1, 4))), F.lit("")),
        F.lit("."),
    )
    return joined.select("doc_id", text.alias("text"))


def placeholders(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, hint): the distinct placeholders of each line, in order."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)))
    return lines.select("doc_id", "line_no", F.posexplode(found).alias("pos", "hint"))


def merged_runs(hunks: DataFrame) -> DataFrame:
    """(doc_id, hunk_ord, kind, section, n): consecutive `same` hunks of one section become one; the rest are numbered anew."""
    order = Window.partitionBy("doc_id").orderBy("hunk_ord")
    joins = (F.col("kind") == "same") & (F.lag("kind").over(order) == "same") & F.col("section").eqNullSafe(F.lag("section").over(order))
    runs = hunks.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    grouped = runs.groupBy("doc_id", "__run").agg(F.first("kind").alias("kind"), F.first("section").alias("section"), F.count("*").alias("n"))
    return grouped.select("doc_id", F.col("__run").cast("int").alias("hunk_ord"), "kind", "section", "n")


def change_log(hunks: DataFrame) -> DataFrame:
    """(doc_id, section, place, n, n_accepted): the changed hunks of each section, sections in the order in which they first change; hunks without a section are one of their own."""
    changed = hunks.filter("kind <> 'same'").groupBy("doc_id", "section").agg(F.min("hunk_ord").alias("first"), F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return changed.withColumn("place", place).select("doc_id", "section", "place", "n", "n_accepted")


def rejoined(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, origins): wrapped lines put together; a line goes on if the one before ends in a comma or semicolon, or has no end and the line starts in lower case."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("text").over(order)
    goes_on = before.rlike(r"[,;]$") | (~before.rlike(r"[.!?:;]$") & F.col("text").rlike(r"^[a-z]"))
    runs = lines.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    own = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return runs.groupBy("doc_id", "__run").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"), F.transform(own, lambda x: x["line_no"]).alias("origins")).drop("__run")


def unreferenced(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """(doc_id, line_no): original lines that no hunk refers to."""
    used = hunks.select("doc_id", F.explode("original_lines").alias("line_no")).distinct()
    return lines.select("doc_id", "line_no").join(used, ["doc_id", "line_no"], "left_anti")


def compose_text(hunks: DataFrame, rewrites: DataFrame, lines: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): accepted hunks give their rewrite lines, others their original ones, in order, with filled placeholders.

    hunks: (doc_id, hunk_ord, accepted, original_lines, rewrite_lines); values: (doc_id, hint, value).
    """
    chosen = F.when(F.col("accepted"), F.col("rewrite_lines")).otherwise(F.col("original_lines"))
    picked = hunks.select("doc_id", "hunk_ord", "accepted", F.posexplode(chosen).alias("pos", "line_no"))
    both = rewrites.select("doc_id", "line_no", F.lit(True).alias("accepted"), "text").unionByName(lines.select("doc_id", "line_no", F.lit(False).alias("accepted"), "text"))
    texts = picked.join(both, ["doc_id", "line_no", "accepted"])
    if values is not None:
        filled = values.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("hint", "value"))).alias("fill"))
        joined = texts.join(filled, "doc_id", "left")
        hints = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)))
        put = F.aggregate(hints, F.col("text"), lambda t, h: F.coalesce(F.replace(t, F.concat(F.lit("[["), h, F.lit("]]")), F.element_at("fill", h)), t))
        texts = joined.withColumn("text", put)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("hunk_ord", "pos", "text"))), lambda x: x["text"])
    return texts.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


def export_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): bullets get a dash, headings capitals and a blank line before, but for the first line."""
    shown = F.when(F.col("kind") == "bullet", F.concat(F.lit("- "), "text")).when((F.col("kind") == "heading") & (F.col("line_no") > 1), F.concat(F.lit("\n"), F.upper("text"))).when(F.col("kind") == "heading", F.upper("text")).otherwise(F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("shown")))), lambda x: x["shown"])
    return lines.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


def unsupported_numbers(rewrites: DataFrame, originals: DataFrame) -> DataFrame:
    """(doc_id, line_no, number): numbers of a rewrite that its original document doesn't hold; years are exempt."""
    number = lambda: F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", P.PLACEHOLDER, ""), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))).alias("number")
    allowed = originals.select("doc_id", number()).distinct()
    return rewrites.select("doc_id", "line_no", number()).filter(~F.col("number").rlike(r"^(19|20)\d{2}$")).join(allowed, ["doc_id", "number"], "left_anti")


#: Terms that are written in a way of their own, and names of the groups of skills; fixed values.
SHOWN = {"ci/cd": "CI/CD", "sql": "SQL", "aws": "AWS", "gcp": "GCP", "api": "API", "rest api": "REST APIs", "html": "HTML", "css": "CSS", "seo": "SEO", "sem": "SEM", "crm": "CRM", "erp": "ERP", "kpis": "KPIs"}
GROUPS = {"language": "Languages", "data": "Data", "infrastructure": "Infrastructure", "web": "Web", "office": "Office", "business": "Business", "skill": "Skills"}
BUZZWORD = r"(?i)^(team ?player|hard[- ]?work(er|ing)|detail[- ]oriented|self[- ]starter|go[- ]getter|fast learner|quick learner|results[- ]driven|passionate|motivated|dynamic|multitask(ing|er)?|people person|strong work ethic)"


def shown_term(term: Column) -> Column:
    """A term as it is written in a list: its own way, else each word's first letter in upper case, also after a slash."""
    words = F.transform(F.split(F.lower(term), "(?<=[ /])"), lambda w: upper_first(w))
    return F.coalesce(_lookup(SHOWN, F.lower(term)), F.array_join(words, ""))


def distinct_items(items: DataFrame) -> DataFrame:
    """(doc_id, ord, item) without blanks, buzzwords and repeats in another case; the first spelling stays."""
    bare = items.withColumn("item", F.trim("item")).filter((F.col("item") != "") & ~F.col("item").rlike(BUZZWORD))
    return bare.groupBy("doc_id", F.lower("item").alias("__of")).agg(F.min(F.struct("ord", "item")).alias("i")).select("doc_id", "i.*")


def grouped_skills(items: DataFrame, terms: DataFrame, single: int = 8, most: int = 4) -> DataFrame:
    """(doc_id, ord, label, text): the skills of each document in groups of the dictionary's categories.

    Up to `single` skills are one group. Of more than `most` groups the smallest, later ones first
    among equals, go into one named Also, with what the dictionary doesn't know.
    """
    names = terms.select(F.explode(F.concat(F.array("term"), "aliases")).alias("__name"), "category").groupBy("__name").agg(F.max("category").alias("category"))
    known = distinct_items(items).join(names, F.lower("item") == F.col("__name"), "left")
    label = F.coalesce(_lookup(GROUPS, F.col("category")), F.lit("Also"))
    by_doc = Window.partitionBy("doc_id")
    sized = known.withColumn("n", F.count("*").over(by_doc)).withColumn("label", F.when(F.col("n") <= single, "Skills").otherwise(label))
    groups = sized.groupBy("doc_id", "label").agg(F.count("*").alias("size"), F.min("ord").alias("first"))
    named = F.col("label") != "Also"
    ranked = groups.withColumn("place", F.row_number().over(by_doc.orderBy(F.desc(named), F.desc("size"), "first"))).withColumn("n_groups", F.count("*").over(by_doc))
    # With Also among them, one group fewer keeps its own name.
    kept = ranked.withColumn("label2", F.when(named & ((F.col("n_groups") <= most) | (F.col("place") < most)), F.col("label")).otherwise("Also")).select("doc_id", "label", "label2")
    placed = sized.join(kept, ["doc_id", "label"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), ", ")
    lines = placed.groupBy("doc_id", F.col("label2").alias("label")).agg(F.min("ord").alias("first"), text.alias("text"))
    order = by_doc.orderBy(F.col("label") == "Also", "first")
    return lines.withColumn("ord", F.row_number().over(order)).select("doc_id", "ord", "label", "text")


#: Order of the sections of a rebuilt document, and their headings; fixed values.
SECTION_ORDER = ("contact", "summary", "experience", "projects", "education", "skills", "certifications", "awards", "publications", "volunteer", "languages", "interests", "other")
LABELS = {s: s.capitalize() for s in SECTION_ORDER} | {"volunteer": "Volunteer Experience", "other": "Additional"}


def section_label(section: Column) -> Column:
    return _lookup(LABELS, section)


def rebuilt(lines: DataFrame, entries: DataFrame, terms: DataFrame, own_order: bool = False, hold: Hold | None = None) -> DataFrame:
    """(doc_id, line_no, section, kind, text, origins): a document built anew, section by section, each line with the original lines it comes from.

    Sections go by SECTION_ORDER, or in their own order with contact and summary first. Headings say
    the section's name; entry headers take one form; weak bullets of work are rewritten; skills are
    grouped. Lines of headers, footers and text boxes follow the contact lines. Every original line
    but a heading is the origin of some line. hold: what to do with the tables of bullets that recur, if anything.
    """
    body = lines.filter("not opens").withColumn("sec", F.when(F.col("source").isin("header", "footer", "textbox"), "contact").otherwise(F.col("section")))
    firsts = body.groupBy("doc_id", "sec").agg(F.min("line_no").alias("at"))
    fixed = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("sec"))
    place = F.when(F.col("sec").isin("contact", "summary"), fixed).otherwise(F.col("at") + 100) if own_order else F.when(fixed == 0, 99).otherwise(fixed)
    placed = firsts.withColumn("place", place.cast("long"))
    headings = placed.filter("sec <> 'contact'").select("doc_id", "place", F.col("sec").alias("section"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit("heading").alias("kind"), section_label(F.col("sec")).alias("text"), F.array().cast("array<int>").alias("origins"))
    own = body.join(placed.select("doc_id", "sec", "place"), ["doc_id", "sec"])
    head = own.filter("header").groupBy("doc_id", "place", "sec", "entry").agg(F.array_sort(F.collect_list("line_no")).cast("array<int>").alias("origins"))
    titles = head.join(headlines(entries), ["doc_id", "entry"]).select("doc_id", "place", F.col("sec").alias("section"), F.col("entry").cast("int").alias("o1"), F.lit(0).alias("o2"), F.lit("entry").alias("kind"), "text", "origins")
    rest = own.filter("not coalesce(header, false) and sec <> 'skills'")
    work = F.coalesce(F.col("sec").isin("experience", "projects", "volunteer") & (F.col("kind") == "bullet"), F.lit(False))
    weak = bullet_strength(F.col("text"))["score"] < 3
    bullets = by_text(rest.filter(work).select("doc_id", "place", "sec", "entry", "line_no", "kind", "text"), with_column("new", F.when(weak, rewritten_bullet(F.col("text"))).otherwise(F.col("text"))), hold)
    every_rest = bullets.unionByName(rest.filter(~work).select("doc_id", "place", "sec", "entry", "line_no", "kind", "text", F.col("text").alias("new")))
    said = every_rest.select("doc_id", "place", F.col("sec").alias("section"), F.coalesce("entry", F.lit(0)).cast("int").alias("o1"), F.col("line_no").cast("int").alias("o2"), "kind", F.col("new").alias("text"), F.array(F.col("line_no").cast("int")).alias("origins"))
    skills = own.filter("sec = 'skills'")
    parts = skills.select("doc_id", "line_no", F.posexplode(F.split("text", r"[,|•·;]")).alias("pos", "item"))
    lists = grouped_skills(parts.select("doc_id", (F.col("line_no") * 1000 + F.col("pos")).alias("ord"), "item"), terms)
    whole = skills.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list("line_no")).cast("array<int>").alias("origins"))
    listed = lists.join(whole, "doc_id").select("doc_id", "place", F.lit("skills").alias("section"), F.lit(1).alias("o1"), F.col("ord").cast("int").alias("o2"), F.lit("text").alias("kind"), F.when(F.col("label") == "Skills", F.col("text")).otherwise(F.concat_ws(": ", "label", "text")).alias("text"), "origins")
    order = Window.partitionBy("doc_id").orderBy("place", "o1", "o2")
    every = headings.unionByName(titles).unionByName(said).unionByName(listed)
    return every.withColumn("line_no", F.row_number().over(order)).select("doc_id", "line_no", "section", "kind", "text", "origins")
