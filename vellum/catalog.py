"""The registered queries of the document engine; plans.oracle has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import schema, tokens
from vellum.functions.text import bullet_strength, count_words, has_metric
from vellum.operators import fixes, gains, geometry, layout, machine_view, rewrite, store
from vellum.operators.alignment import aligned
from vellum.operators.findings import all_findings, document_findings, entry_findings, known_contact, line_findings, skeleton_findings, work_bullets
from vellum.operators.hunks import rewrite_hunks
from vellum.operators.keywords import implications, infer_roles, keyword_hits, match_percent, match_targets, named_candidates, ordered_missing, overused
from vellum.operators.score import engine_scores, overall_scores, plan_items, projected_scores, weak_spots
from vellum.operators.texts import by_text, with_column
from vellum.operators.wrap import wrapped
from vellum.plans import oracle, rule_twin
from vellum.plans.corpus import EVENT_JSON, planted_corpus
from vellum.plans.roundtrip import RoundTrip, change_counts, round_trip, score_changes
from vellum.plans.tables import build_model, corpus, corpus_findings, corpus_lines, corpus_model, corpus_scores, written
from vellum.plans.terms import ROLES, TOKEN_KEY, default_targets, default_terms
from vellum.plans.verify import composed_model, raw_totals
from vellum.sources.text import link_targets, scan_lines
from vellum.sources.tree import TEXT, descendants, element_tree, inner_texts
from vellum.streaming import events as stream
from vellum.streaming import rollup

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(table(spark, sf_dir, "documents"))


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_lines(spark, sf_dir).withColumn("text", F.regexp_replace("text", P.BULLET_GLYPH, ""))


def _rule(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return corpus(spark, sf_dir).line_rule(rule).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 1).alias("cost"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_overall(spark, sf_dir)


@query
def q_line_scan(spark, sf_dir):
    n = F.count("*")
    return _doc_lines(spark, sf_dir).groupBy("doc_id").agg(
        n.alias("n_lines"), F.sum(count_words(F.col("text"))).alias("n_words"), F.sum(F.length("text")).alias("n_chars"), F.greatest(F.lit(1), F.ceil(n / 55)).alias("pages")
    )


@query
def q_wrapped_lines(spark, sf_dir):
    """How many rows each line of a document takes on a page, and its first row."""
    rows = wrapped(_doc_lines(spark, sf_dir), 10.0, 200.0)
    return rows.groupBy("doc_id", "line_no").agg(F.count("*").cast("int").alias("n_rows"), F.min_by("text", "row_no").alias("first_row"))


@query
def q_contact_lines(spark, sf_dir):
    email, phone = F.col("text").rlike(P.EMAIL), F.col("text").rlike(P.PHONE)
    at = lambda c: F.when(c, F.col("line_no"))
    first = F.min_by(F.regexp_extract("text", P.EMAIL, 0), at(email))
    return _doc_lines(spark, sf_dir).filter(email | phone).groupBy("doc_id").agg(F.min(at(email)).alias("email_line"), F.min(at(phone)).alias("phone_line"), first.alias("email"))


@query
def q_metric_lines(spark, sf_dir):
    return _doc_lines(spark, sf_dir).filter(has_metric(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n_metric"))


@query
def q_first_person(spark, sf_dir):
    return _doc_lines(spark, sf_dir).filter(F.col("text").rlike(P.FIRST_PERSON)).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


@query
def q_acronyms(spark, sf_dir):
    return named_candidates(table(spark, sf_dir, "documents"))


@query
def q_page_tags(spark, sf_dir):
    inner = lambda tag: F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.coalesce(F.get(inner("h1"), F.lit(0)), F.lit("")).alias("raw_h1"), F.size(link_targets(F.col("html"))).alias("n_links"), F.size(inner("p")).alias("n_paragraphs"))


def _page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_tree(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html", html=True)


@query
def q_page_elements(spark, sf_dir):
    """How many elements of each name a page has."""
    return _page_tree(spark, sf_dir).filter(F.col("tag") != TEXT).groupBy(F.col("doc_id").alias("page_id"), "tag").agg(F.count("*").alias("n"))


@query
def q_nested_texts(spark, sf_dir):
    """The text of every paragraph and list item in the article of a page, but not in what is set apart inside it."""
    tree = written(_page_tree(spark, sf_dir))
    tops = tree.filter("tag in ('article', 'main')")
    apart = ("aside", "footer", "nav", "form")
    found = descendants(tree, tops, "p", apart).unionByName(descendants(tree, tops, "li", apart)).select("doc_id", "pre", "last").distinct()
    return inner_texts(tree, found).select(F.col("doc_id").alias("page_id"), F.col("top").alias("node"), "text")


@query
def q_bullet_strength(spark, sf_dir):
    return work_bullets(corpus(spark, sf_dir).lines).select("doc_id", "line_no", bullet_strength(F.col("text")).alias("s")).select("doc_id", "line_no", "s.*")


@query
def q_impact(spark, sf_dir):
    marks = q_bullet_strength(spark, sf_dir)
    return marks.groupBy("doc_id").agg(F.count("*").alias("n_bullets"), F.round(F.sum("score") / (3.0 * F.count("*")), 6).alias("mean"), F.sum("metric").alias("with_number"), F.sum("verb").alias("with_verb"))


@query
def q_weak_openers(spark, sf_dir):
    return _rule(spark, sf_dir, "weak-opener")


@query
def q_filler(spark, sf_dir):
    return _rule(spark, sf_dir, "filler")


@query
def q_generic_phrases(spark, sf_dir):
    return _rule(spark, sf_dir, "generic-phrase")


@query
def q_repeated_openers(spark, sf_dir):
    words = work_bullets(corpus(spark, sf_dir).lines).filter("opener <> ''")
    own = F.array_sort(F.collect_list(F.struct("pos", "line_no", "weak")))
    grouped = words.groupBy("doc_id", F.col("opener").alias("word")).agg(F.count("*").alias("n"), own.alias("own"))
    return grouped.filter("n >= 3 and not own[0].weak").select("doc_id", "word", "n", F.col("own")[2]["line_no"].alias("third"))


@query
def q_shapes(spark, sf_dir):
    return work_bullets(corpus(spark, sf_dir).lines).groupBy("doc_id", "shape").agg(F.count("*").alias("n"))


@query
def q_keyword_hits(spark, sf_dir):
    return keyword_hits(_text_lines(spark, sf_dir), default_terms(spark)).groupBy("doc_id", "term").agg(F.sum("hits").alias("hits"), F.count("*").alias("n_lines"))


@query
def q_match_percent(spark, sf_dir):
    return match_percent(match_targets(_text_lines(spark, sf_dir), default_terms(spark), default_targets(spark)))


@query
def q_overused(spark, sf_dir):
    lines = _text_lines(spark, sf_dir)
    words = lines.groupBy("doc_id").agg(F.sum(count_words(F.col("text"))).alias("words"))
    return overused(match_targets(lines, default_terms(spark), default_targets(spark)), words)


@query
def q_implications(spark, sf_dir):
    return implications(default_terms(spark))


@query
def q_supported(spark, sf_dir):
    matches = match_targets(_text_lines(spark, sf_dir), default_terms(spark), default_targets(spark))
    return matches.filter("hits = 0").select("doc_id", "term", "weight", "supported_by")


@query
def q_roles(spark, sf_dir):
    m = corpus(spark, sf_dir)
    titles = m.entries.filter("section = 'experience' and title is not null").select("doc_id", F.col("title").alias("text"))
    return infer_roles(titles, m.lines.filter("section in ('skills', 'summary')"), default_terms(spark), ROLES)


@query
def q_kinds(spark, sf_dir):
    return corpus(spark, sf_dir).read.groupBy("kind", "section").agg(F.count("*").alias("n"))


@query
def q_sections(spark, sf_dir):
    return corpus(spark, sf_dir).read.filter("not opens").groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query
def q_entries(spark, sf_dir):
    return corpus(spark, sf_dir).entries.filter("section = 'experience'").select("doc_id", "header_line", "dates", "n_bullets")


@query
def q_years(spark, sf_dir):
    return corpus(spark, sf_dir).years


@query
def q_date_forms(spark, sf_dir):
    dates = F.col("dates")
    form = F.when(dates.rlike(r"\d{1,2}/\d{2,4}"), "numeric").when(dates.rlike(r"(?i)[a-z]{3,}\.?\s*'?\d{2,4}"), "month-year").otherwise("year")
    roles = corpus(spark, sf_dir).entries.filter("section = 'experience' and dates is not null")
    return roles.groupBy("doc_id").agg(F.countDistinct(form).alias("forms")).filter("forms > 1")


@query
def q_missing_sections(spark, sf_dir):
    own = corpus(spark, sf_dir).scored("documents").filter(F.col("rule_id").isin("missing-education", "missing-skills"))
    return own.groupBy("doc_id").agg(F.sum("cost").cast("int").alias("cost"))


@query
def q_contact_missing(spark, sf_dir):
    tone = F.coalesce(F.substring_index("email", "@", 1).rlike(P.EMAIL_TONE), F.lit(False))
    return corpus(spark, sf_dir).contact.select("doc_id", F.isnull("email").alias("no_email"), F.isnull("phone").alias("no_phone"), F.isnull("linkedin").alias("no_linkedin"), tone.alias("odd_tone"))


@query
def q_findings(spark, sf_dir):
    return corpus_findings(spark, sf_dir).groupBy("category", "rule_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 1).alias("cost"))


@query
def q_category_scores(spark, sf_dir):
    return corpus_scores(spark, sf_dir).select("doc_id", "category", "score")


@query
def q_overall(spark, sf_dir):
    return overall_scores(corpus_scores(spark, sf_dir))


@query
def q_engines(spark, sf_dir):
    return engine_scores(corpus_scores(spark, sf_dir), q_hazards(spark, sf_dir))


@query
def q_hazards(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return layout.hazards(m.layout, m.contact)


@query
def q_layout(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return layout.layout_facts(m.layout, m.classified).drop("chars")


@query
def q_dropped(spark, sf_dir):
    return layout.dropped_elements(corpus(spark, sf_dir).layout).select("doc_id", "kind", "place", "n", "severity")


@query
def q_reading_issues(spark, sf_dir):
    return layout.reading_issues(corpus(spark, sf_dir).layout).groupBy("doc_id", "kind").agg(F.sum("n").alias("n"))


@query
def q_parse_rules(spark, sf_dir):
    m = corpus(spark, sf_dir)
    own = m.scored("layout").unionByName(m.scored("documents")).filter("category = 'parse'")
    return own.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 1).alias("cost"))


@query
def q_plan(spark, sf_dir):
    return plan_items(corpus_findings(spark, sf_dir), corpus_scores(spark, sf_dir))


@query
def q_projected(spark, sf_dir):
    return projected_scores(q_overall(spark, sf_dir), q_plan(spark, sf_dir))


@query
def q_weak_spots(spark, sf_dir):
    return weak_spots(corpus_scores(spark, sf_dir))


@query
def q_planted_rules(spark, sf_dir):
    """Findings of the rules that only the planted documents break."""
    terms = default_terms(spark)
    m = build_model(written(planted_corpus(spark, sf_dir)), terms, default_targets(spark), 2024)
    titles = m.entries.filter("section = 'experience' and title is not null").select("doc_id", F.col("title").alias("text"))
    m = replace(m, roles=written(infer_roles(titles, m.lines.filter("section in ('skills', 'summary')"), terms, ROLES)))
    scorers = {"lines": line_findings, "documents": document_findings, "entries": entry_findings, "skeletons": skeleton_findings}
    own = all_findings(m, scorers, hold=written).filter(F.col("rule_id").isin(*rule_twin.PLANTED))
    return own.select("doc_id", "rule_id", "line_no", "cost")


@query
def q_line_marks(spark, sf_dir):
    return store.line_marks(corpus_findings(spark, sf_dir))


def _micros(ts):
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("identity"), "ts", "event_id")


@query
def q_rate_sliding(spark, sf_dir):
    return stream.sliding_limit(_requests(spark, sf_dir), 2).select("event_id", "used")


@query
def q_rate_tumbling(spark, sf_dir):
    return stream.tumbling_limit(_requests(spark, sf_dir), 2).select("kind", "identity", _micros(F.col("start")).alias("start_us"), "used", "over", "retry_after")


@query
def q_event_dedup(spark, sf_dir):
    return stream.first_arrivals(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", by="event_id")


@query
def q_latest_by_key(spark, sf_dir):
    return stream.latest_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), "user_id", "event_type", by="event_id")


@query
def q_stage_durations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("analysis_id"), F.col("turn").alias("seq"), F.col("turn").alias("at"), "role")
    return stream.stage_durations(turns).select(F.col("analysis_id").alias("conv_id"), F.col("seq").alias("turn"), "role", "ended_at")


@query
def q_quiet_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "value")
    return stream.quiet_sessions(events, "30 minutes").select("key", _micros(F.col("started")).alias("started_us"), "n")


@query
def q_json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query
def q_event_errors(spark, sf_dir):
    """Errors of the events by path and reason, and the events without any."""
    events = table(spark, sf_dir, "events").select("event_id", F.expr(EVENT_JSON).alias("json"))
    found = schema.checked(events, "json")
    said = F.explode_outer("errors").alias("e")
    return found.select("kind", said).groupBy(F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("e.path", F.lit("")).alias("path"), F.coalesce("e.reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query
def q_event_fold(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "finding").when(F.col("event_type") == "purchase", "done").otherwise("stage")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") % 7).alias("key"), F.col("props").alias("payload"))
    return stream.fold_batch(events).select("analysis_id", "n_events", F.col("n_findings").alias("n_clicks"), "done")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed: purchases withdraw a finding, sign-ups by value reset, all others find."""
    value, key = F.col("value"), F.col("event_id") % 17
    kind = F.when((F.col("event_type") == "signup") & (value > 100), "reset").when(F.col("event_type") == "purchase", "resolved").otherwise("finding")
    severity = F.when(value > 60, "high").when(value > 20, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("analysis_id"), F.col("event_id").alias("seq"), kind.alias("type"), key.cast("string").alias("key"), (F.floor(value) % 5).cast("int").alias("line_no"), severity.alias("severity"), F.col("event_type").alias("category"))


@query
def q_feed_marks(spark, sf_dir):
    """The marks that a feed of findings leaves on lines."""
    return rollup.feed_marks(_feed(spark, sf_dir))


@query
def q_replaced_order(spark, sf_dir):
    """Event types of each user in the order in which they were last replaced."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return rollup.in_last_order(events, "user_id", of="event_type").select("user_id", "event_type", "place")


@query
def q_change_log(spark, sf_dir):
    """Changed hunks of each order by section, in the order in which sections first change."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind, section = F.when(F.col("l_partkey") % 3 == 0, "edit").otherwise("same"), F.col("l_returnflag")
    hunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("hunk_ord"), kind.alias("kind"), section.alias("section"), (F.col("l_linestatus") == "F").alias("accepted"))
    return rewrite.change_log(hunks)


@query
def q_signed_tokens(spark, sf_dir):
    """A token for each order, and whom it names a year after the order's date."""
    seconds = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400
    token = tokens.signed(F.col("o_orderkey").cast("string"), seconds + (F.col("o_orderkey") % 800) * 86_400, TOKEN_KEY)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), token.alias("token"))
    return orders.select("o_orderkey", "token", tokens.verified(F.col("token"), F.col("seconds") + 365 * 86_400, TOKEN_KEY).alias("subject"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = oracle.CTE["item"].replace("//", "div").replace('"row"', "`row`").replace("FROM part", "FROM {part}")
    return spark.sql(sql, part=table(spark, sf_dir, "part"))


@query
def q_column_histogram(spark, sf_dir):
    return geometry.column_histogram(_items(spark, sf_dir))


@query
def q_longest_gap(spark, sf_dir):
    return geometry.longest_gap(_items(spark, sf_dir))


@query
def q_two_columns(spark, sf_dir):
    return geometry.two_columns(_items(spark, sf_dir))


@query
def q_displaced(spark, sf_dir):
    return geometry.displaced(_items(spark, sf_dir))


@query
def q_table_rows(spark, sf_dir):
    return geometry.flattened_tables(_items(spark, sf_dir))


@query
def q_running_headers(spark, sf_dir):
    return geometry.running_headers(_items(spark, sf_dir))


@query
def q_upper_median(spark, sf_dir):
    return geometry.upper_median(_items(spark, sf_dir), "w")


@query
def q_placeholders(spark, sf_dir):
    work = work_bullets(corpus(spark, sf_dir).lines)
    text = F.concat("text", F.when(F.col("line_no") % 2 == 0, " [[number]]").otherwise(""), F.lit(" [[result: what improved]] [[number]]"))
    return rewrite.placeholders(work.withColumn("text", text)).groupBy("doc_id", "line_no").agg(F.count("*").cast("int").alias("n"))


@query
def q_rewritten(spark, sf_dir):
    work = work_bullets(corpus(spark, sf_dir).lines).filter("strength < 3")
    return by_text(work.select("doc_id", "line_no", "text"), with_column("text", rewrite.rewritten_bullet(F.col("text"))), written)


def _gains(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    terms, targets = default_terms(spark), default_targets(spark)
    m = composed_model(corpus_model(spark, sf_dir), text, terms, targets)
    wanted = terms.join(F.broadcast(targets.select("term")), "term", "left_semi")
    return gains.placeholder_gains(m, written(gains.document_sums(m)), wanted, lambda lines: raw_totals(lines, terms, targets, 2024), hold=written)


@query
def q_placeholder_gains(spark, sf_dir):
    """What each placeholder of the rewritten bullets would gain."""
    return _gains(spark, sf_dir, rewrite.rewritten_bullet(F.col("text")))


def _asked() -> Column:
    """A bullet with placeholders for the number and the result that it lacks."""
    s = bullet_strength(F.col("text"))
    number = F.when(s["metric"] == 0, " ([[quantity or scale]])").otherwise("")
    return F.concat(F.col("text"), number, F.when(s["outcome"] == 0, ", [[result: what improved and by how much]]").otherwise(""))


@query
def q_asked_gains(spark, sf_dir):
    return _gains(spark, sf_dir, _asked()).select("doc_id", "line_no", "hint", "gain")


@query
def q_gain_totals(spark, sf_dir):
    return gains.placeholder_totals(_gains(spark, sf_dir, _asked()))


@query
def q_line_fixes(spark, sf_dir):
    """The rule-based rewrite of each line that has fixable findings, offered for one of its findings and taken for all of them."""
    m = corpus(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("category", "rule_id", "ord", "line_no"))
    found = corpus_findings(spark, sf_dir).select("doc_id", number.alias("finding"), "rule_id", "line_no")
    targets = written(fixes.fix_targets(found, m.lines, m.entries))
    offered = targets.filter("text is not null").select("doc_id", F.col("line_no").alias("seq"), F.element_at("findings", -1).alias("finding"), rewrite.rewritten_bullet(F.col("text")).alias("fix"))
    return fixes.applied_fixes(targets, offered)


@query
def q_normal_dates(spark, sf_dir):
    roles = corpus(spark, sf_dir).entries.filter("section = 'experience'")
    return roles.select("doc_id", "header_line", rewrite.normal_dates(F.col("dates")).alias("dates"))


@query
def q_headlines(spark, sf_dir):
    return rewrite.headlines(corpus(spark, sf_dir).entries)


@query
def q_summaries(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return rewrite.summaries(m.lines, m.entries, m.years)


@query
def q_claims(spark, sf_dir):
    """Each work line with a number and a tool put in that its document may lack."""
    work = work_bullets(corpus(spark, sf_dir).lines)
    claim = F.concat(F.lit(" saved "), (F.col("doc_id") % 50 + 3).cast("string"), F.lit("% of [[12 hours]] with Terraform since 2019"))
    checked = rewrite.checked_claims(work.withColumn("text", F.concat("text", claim)), _text_lines(spark, sf_dir), default_terms(spark), hold=written)
    return checked.select("doc_id", "line_no", "text", "removed", F.array_join("rejected", ",").alias("rejected"))


@query
def q_rebuilt(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return rewrite.rebuilt(m.lines, m.entries, default_terms(spark), hold=written).select("doc_id", "line_no", "section", "kind", "text", F.array_join("origins", ",").alias("origins"))


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus_model(spark, sf_dir)
    return rewrite_hunks(m, known_contact(m), q_plan(spark, sf_dir), default_terms(spark), hold=written, texts=written)


@query
def q_rewrite_hunks(spark, sf_dir):
    """What each document's plan changes, line by line."""
    return _hunks(spark, sf_dir).withColumn("origins", F.array_join("origins", ","))


@query
def q_rewrite_log(spark, sf_dir):
    """How many hunks of each kind a section has, unchanged ones that follow one another as one."""
    hunks = _hunks(spark, sf_dir).withColumn("kind", F.col("change"))
    return rewrite.merged_runs(hunks).groupBy("doc_id", "section", F.col("kind").alias("change")).agg(F.count("*").alias("n_hunks"), F.sum("n").alias("n_lines"))


@query
def q_missing_ranks(spark, sf_dir):
    return ordered_missing(corpus(spark, sf_dir).matches).select("doc_id", "term", "rank")


@query
def q_hunk_runs(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind, section = F.when(F.col("l_partkey") % 3 == 0, "edit").otherwise("same"), F.when(F.col("l_linenumber") < 4, "a").otherwise("b")
    hunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("hunk_ord"), kind.alias("kind"), section.alias("section"))
    return rewrite.merged_runs(hunks)


@query
def q_unreferenced(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"))
    owner = lines.withColumnRenamed("line_no", "l_orderkey")
    hunks = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").join(owner, "l_orderkey").select("doc_id", F.array("l_orderkey").alias("original_lines"))
    return rewrite.unreferenced(lines, hunks).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def q_export(spark, sf_dir):
    return rewrite.export_text(corpus(spark, sf_dir).lines)


def _machine_view(spark: SparkSession, sf_dir: str) -> tuple:
    lay = corpus(spark, sf_dir).layout
    placed = written(machine_view.with_columns(lay.items))
    lines = written(machine_view.seen_lines(placed))
    return lay, lines, written(machine_view.machine_lines(lay, placed, lines))


@query
def q_machine_view(spark, sf_dir):
    """What a machine reads of each document: its rows, and the lines that it loses, scrambles or reads in another order."""
    return machine_view.view_facts(*_machine_view(spark, sf_dir))


@query
def q_machine_rows(spark, sf_dir):
    """The machine's text of each document, and how many visual lines each of its rows is made of."""
    rows = _machine_view(spark, sf_dir)[2]
    return rows.select("doc_id", "row_no", "text", F.size("line_nos").alias("n_lines"), "mangled")


@query
def q_unread_words(spark, sf_dir):
    """Words that a document's lines say more often than the machine's text does."""
    _, lines, rows = _machine_view(spark, sf_dir)
    return machine_view.missing_words(lines, rows)


def _round_trip(spark: SparkSession, sf_dir: str) -> RoundTrip:
    return round_trip(corpus(spark, sf_dir).lines, default_terms(spark), default_targets(spark), 2024)


@query
def q_round_trip(spark, sf_dir):
    """Lines of each document after export and reading again, and how many are read as another kind or in another section."""
    trip = _round_trip(spark, sf_dir)
    read = trip.reread.groupBy("doc_id").agg(F.count_if(F.col("what") == "kind").alias("n_kind"), F.count_if(F.col("what") == "section").alias("n_section"))
    return change_counts(trip.changes).join(read, "doc_id", "left").fillna(0, ["n_kind", "n_section"])


@query
def q_round_trip_scores(spark, sf_dir):
    before = replace(corpus_model(spark, sf_dir), layout=None)
    return score_changes(before, _round_trip(spark, sf_dir).after)


@query
def q_rebuilt_changes(spark, sf_dir):
    """What became of each line of the rebuilt documents: kept in its order, moved, changed, left out or added."""
    m = corpus(spark, sf_dir)
    whole = rewrite.rebuilt(m.lines, m.entries, default_terms(spark), hold=written)
    return aligned(m.lines.select("doc_id", "line_no", "text"), whole.select("doc_id", "line_no", "text"), hold=written)


@query
def q_history(spark, sf_dir):
    """Orders stand for stored documents: those that are filled have an analysis; those of an urgent priority were removed."""
    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("doc_id"))
    docs = orders.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    analyses = orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("score"))
    return store.history(ids, docs, analyses).select("session_id", "doc_id", "score")


@query
def q_compare_runs(spark, sf_dir):
    """Two runs over all parts: the largest size of each brand and manufacturer, and its highest price in hundreds, where there is one above half of all."""
    part = table(spark, sf_dir, "part")
    run = lambda value, least: part.groupBy(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("category")).agg(F.max(value).cast("int").alias("score")).filter(F.col("score") >= least)
    return store.compare_runs(run(F.col("p_size"), 25), run(F.floor(F.col("p_retailprice") / 100), 11))


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | rule_twin.SQL
