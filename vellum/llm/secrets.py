"""Secret scans over a trigram inverted index.

Every rule is a regular expression, from which a Boolean trigram query is derived (see
trigrams): an OR of ANDs of trigrams that any match holds. The index has a posting for each
row and trigram that some query needs. Intersecting the postings gives the candidates, which
the regular expression then verifies. A rule without mandatory trigrams scans every text.

Postings and candidates carry a row's key, a hash of its id and text, and no text. Candidates
within a checked number are broadcast to the texts; beyond it both meet in a salted join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import meet, packed, refuse_clash, unpacked, written
from vellum.llm.trigrams import trigram_query

#: Matches that are gone through one by one between two partial results, and characters of a piece of a text.
BLOCK, PIECE = 256, 1 << 14
SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """kind: name in the spans; pattern: Java regular expression.

    min_chars: least length of the group `group`; matches that fail it are dropped after matching.
    """

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1


#: The base kinds, in the order in which ties at one start are listed; fixed values.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        min_chars=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known token formats; they only add spans.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES


def row_key(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with __key, a hash of id and text: rows that repeat both share it, null ids don't."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def postings(keyed: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(__key, gram): one posting for each of the trigrams that a text holds, in any case."""
    by_first: dict[str, list[str]] = {}
    for g in sorted(trigrams):
        first, *rest = ("\\" + c if not c.isalnum() else c for c in g)
        by_first.setdefault(first, []).append("".join(rest))
    choice = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({choice}))"), F.lit(1))
    return keyed.select("__key", F.explode(F.array_distinct(found)).alias("gram"))


def candidates(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(__key, __kinds): the rules whose trigram query a row's postings satisfy.

    Postings meet by row, not by trigram, so that a trigram in a third of all texts needs no
    list of its own. The queries are a few rows that the rules fix.
    """
    terms = [(r.kind, f"{r.kind}/{i}", g, len(b)) for r in rules for i, b in enumerate(trigram_query(r.pattern)) for g in b]
    spark = keyed.sparkSession
    query = spark.createDataFrame(terms, "kind string, branch string, gram string, needed int")
    hits = postings(keyed, sorted({t[2] for t in terms})).join(F.broadcast(query), "gram")
    whole = hits.groupBy("__key", "kind", "branch", "needed").agg(F.countDistinct("gram").alias("n")).filter("n = needed")
    return whole.groupBy("__key").agg(F.collect_set("kind").alias("__kinds"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, zero: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before it, item) for each item of a non-empty array; kind: the result's type.

    An array that grows item by item is copied each time, so the items are taken in blocks: the
    states at the blocks' starts first, then each block on its own.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))

    def from_blocks(blocks: Column) -> Column:
        pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
        starts = F.aggregate(blocks, pair(zero, F.slice(F.array(zero), 1, 0)), lambda acc, b: pair(F.aggregate(b, acc["state"], advance), F.concat(acc["out"], F.array(acc["state"]))))["out"]
        each = lambda z: F.aggregate(z["block"], pair(z["state"], F.array().cast(kind)), lambda acc, x: pair(advance(acc["state"], x), F.concat(acc["out"], emit(acc["state"], x))))["out"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("state")), each))

    return _with(blocks, from_blocks)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,end,kind>> of the rule's leftmost non-overlapping matches, in code points.

    Splitting at the pattern gives the text between the matches; running sums of both lengths
    give every start, so no text is searched twice for one match.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("len"), F.transform(held, lambda h: F.length(h)).alias("held"))
    none = F.array().cast(SPANS)

    def emit(at: Column, part: Column) -> Column:
        start = at + part["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + part["len"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.when(part["held"] >= rule.min_chars, one.cast(SPANS)).otherwise(none)

    spans = _with(parts, lambda p: _running(p, F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(x["len"], F.lit(0)), emit, SPANS))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, text (null: empty), spans, by start, then rule order, and the kept columns.

    A document without any match has an empty array. Rows that repeat an id are each scanned on
    their own text. A null id is a document like any other. An empty table gives an empty
    result; other columns are not read; columns to keep that are named as the result's own are an error.
    """
    refuse_clash(keep, ("doc_id", "text", "spans"))
    own = row_key(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), packed(keep).alias("__kept")))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    none = F.array().cast(SPANS)
    joined = meet(own, written(candidates(own, indexed)), "__key") if indexed else own.withColumn("__kinds", F.array().cast("array<string>"))
    each = [
        rule_spans(F.col("text"), r, i) if r not in indexed else F.when(F.array_contains("__kinds", r.kind), rule_spans(F.col("text"), r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return joined.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"), *unpacked(keep, "__kept"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (sorted by start) replaced by [kind]; of overlapping spans the first names the cut.

    The text is taken in pieces, so that a cut costs no more than a piece.
    """
    cut = "array<struct<start:int,end:int,kind:string>>"

    def fresh(at: Column, s: Column) -> Column:
        """A span that begins before the end of an earlier one cuts on from there and has no name of its own."""
        start = F.greatest(at, s["start"])
        one = F.array(F.struct(start.alias("start"), s["end"].alias("end"), F.when(s["start"] >= at, s["kind"]).alias("kind"))).cast(cut)
        return F.when(s["end"] > at, one).otherwise(F.array().cast(cut))

    cuts = _running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), fresh, cut)
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def without(piece: Column, first: Column, own: Column) -> Column:
        """The piece, whose first character is the text's character `first`, without the cuts that overlap it."""
        size = F.length(piece)
        ends = F.concat(F.array(F.lit(0)), F.transform(own, lambda c: F.least(size, c["end"] - first)))

        def pieces_of(ends: Column) -> Column:
            gap = lambda c, i: F.substring(piece, F.get(ends, i) + 1, F.greatest(F.lit(0), c["start"] - first) - F.get(ends, i))
            name = lambda c: F.when(c["kind"].isNotNull() & (c["start"] >= first), F.concat(F.lit("["), c["kind"], F.lit("]"))).otherwise("")
            return F.concat(F.array_join(F.transform(own, lambda c, i: F.concat(gap(c, i), name(c))), ""), F.substring(piece, F.element_at(ends, -1) + 1, size))

        return _with(ends, pieces_of)

    def cleaned(cuts: Column) -> Column:
        one = lambda p, i: _with(F.filter(cuts, lambda c: (c["start"] < (i + 1) * PIECE) & (c["end"] > i * PIECE)), lambda own: without(p, i * PIECE, own))
        return F.array_join(F.transform(pieces, one), "")

    return F.when(F.size(spans) > 0, _with(cuts, cleaned)).otherwise(text)
