"""Every operator against a brute-force version, an exact round trip or its SQL, and on odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import same_rows
from pyspark.sql import functions as F

from vellum.llm import chat, common, decontaminate, html_text, language, lm, mixing, queries, secrets, simhash, tokens, topk, trigrams
from vellum.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kinds int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang"), columns.get("source", "s"), 0, "own", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns named as the operators' own."""
    long = " ".join(f"word{i % 977} and token_{i}" for i in range(60_000))
    rows = [(None, None, None, None, None, None, None), (1, None, "en", "a", 0, "x", 1), (2, "", None, None, 0, None, None), (3, " \t\n", "en", "a", 3, "x", 1)]
    rows += [(4, "one two three four five six seven eight", "en", "b", 9, "x", 1)] * 3 + [(5, long, "en", "b", 9, "x", 1), (6, "a" * 200_000, "de", "b", 9, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


# 1: HTML


def test_html_keeps_the_article_and_drops_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><div id="ad_top">Buy the thing of the year now.</div>
    <article><header><h2>A &amp; B</h2></header><p>First  paragraph<br>with the&nbsp;words of an article that is long enough to be decided by itself.<p>Short.</p><form><p>Your mail</p><input name="x"></form>
    <div class="comments"><p>I like the article and the site that it is on, for what it is worth to you all.</p></div></article>
    <aside class="sidebar">More of the same</aside><footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_blocks(page) == ["A & B", "First paragraph with the words of an article that is long enough to be decided by itself.", "Short."]


def test_html_keeps_formulas_and_an_article_in_an_oddly_named_block():
    text = "The quick brown fox is in the garden of the house and it was there for all of the day, as it is with the foxes that we have. " * 2
    formula = f"<article><p>{text}</p><p>The area of the circle is <math><mi>A</mi><mo>=</mo><mn>3</mn><annotation>A=3</annotation></math> and it was measured.</p></article>"
    assert html_text.main_blocks(formula)[1] == "The area of the circle is A=3 and it was measured."
    assert html_text.main_blocks(f"<body><div class='social-page related-content'><p>{text}</p></div><div>Menu</div></body>") == [text.strip()]
    assert html_text.main_blocks(f"<body><div class='related'><p>{text}</p></div><article><p>{text}</p></article></body>") == [text.strip()]


def test_html_without_landmarks_goes_by_density_and_neighbours():
    text = "The quick brown fox is in the garden of the house and it was there for all of the day, as it is with the foxes that we have. " * 2
    page = f"<body><div><a href=/>Home</a> <a href=/>News</a> <a href=/>About the site</a></div><div>Menu</div><div>{text}</div><div>Then it left.</div><div>{text}</div><div><a href=/>next</a></div></body>"
    assert html_text.main_blocks(page) == [text.strip(), "Then it left.", text.strip()]


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>a<b>c", "</p></div>x", "<script>", "<a href='", "&#x110000;&bogus;", "<!-- open", "<div class=ad><article>kept text</article>"])
def test_html_never_fails(page):
    html_text.main_blocks(page)


def test_html_null_repeated_and_clashing(spark):
    page = "<article><p>x</p></article>"
    rows = spark.createDataFrame([(1, "u", None, "t", 9), (2, None, "", "t", 9), (None, "u", page, None, 9), (3, "v", page, "t", None), (3, "v", page, "t", None)], "page_id long, url string, html string, text string, n_chars int")
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(rows).collect()) == Counter([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "v", "x", 1), (3, "v", "x", 1)])


class _Article(HTMLParser):
    """What a plain parser finds inside the article of the generated pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, _attributes):
        self.inside = self.inside or tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "ul", "li", "article") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.blocks += [""] if tag in ("p", "h1", "ul", "li", "article") else []
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_html_equals_a_plain_parser_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        parser = _Article()
        parser.feed(r.html or "")
        parser.close()
        assert got[r.page_id] == "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


PROSE = "The quick brown fox is in the garden of the house and it was there for all of the day, as it is with the foxes that we have. " * 2
OTHER = {
    "ru": "Быстрая коричневая лиса прыгает через ленивую собаку, которая спит у старого дома возле тихой реки. " * 3,
    "ja": "敏捷な茶色の狐は、のんびりした犬を飛び越えて、古い家のそばの静かな川まで走って行きました。" * 5,
    "fi": "Nopea ruskea kettu hyppäsi laiskan koiran yli ja juoksi vanhan talon ohi joelle asti ennen iltaa. " * 3,
}


@pytest.mark.parametrize("lang", OTHER)
def test_html_in_languages_without_stop_words(lang):
    text = OTHER[lang].strip()
    page = f"<body><div><a href=/>Home</a></div><div><p>{text}</p><p>OK</p><p>{text}</p></div><div class='footer'>2024</div></body>"
    assert html_text.main_blocks(page) == [text, "OK", text]


def test_html_class_names_are_votes():
    text = PROSE.strip()
    notice = "<div class='cookie-notice'><p>We use cookies for all of it, and that is that for you and the site of ours.</p></div>"
    assert html_text.main_blocks(f'<div class="social-policy-article"><p>{text}</p></div>') == [text]
    assert html_text.main_blocks(f"<article><p>{text}</p><div class='legal-analysis'><h2>Law</h2><p>{text[:120]}</p></div><section id=notice-board><p>{text}</p></section>{notice}</article>") == [text, "Law", text[:120].strip(), text]
    assert html_text.main_blocks(f"<form id=page><p>{text}</p><p>More of it.</p></form>") == [text, "More of it."]
    assert html_text.main_blocks(f"<div><p>{text}</p></div><div class='comments'><p>{text}</p></div><form><p>{text}</p></form>{notice}") == [text]
    assert html_text.main_blocks(f"<nav>{text}</nav><footer>{text}</footer><div class=comments>{text}</div>") == []


def test_html_keeps_facts_between_paragraphs():
    facts = "Zephyr 4400 rpm, Bosch gearbox, Kevlar casing, steel axle, rubber wheels, chrome bumper, leather seats"
    assert html_text.main_blocks(f"<div><p>{PROSE}</p><ul><li>{facts}</li></ul><p>{PROSE}</p></div>") == [PROSE.strip(), facts, PROSE.strip()]


@pytest.mark.parametrize("unit", ["<div>|</p>", "<b>|</i>", '<a "|', '<a x="|', "<![CDATA[|", "<title>|", "<b>|<p></p>", "<i><div>|<b>|</i>", "<|", "<li><dd>|", "<script></script|"])
def test_html_takes_linear_time(unit):
    parts = unit.split("|")
    page = "".join(x * (300_000 // len(unit)) for x in parts if x)
    began = time.perf_counter()
    html_text.main_blocks(page)
    assert time.perf_counter() - began < 5


# 2: secrets


def brute_secrets(text):
    rules = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), i, kind, m.end()) for i, (kind, rule, fits) in enumerate(rules) for m in rule.finditer(text) if fits(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_secrets_match_brute_force(spark, sf_dir):
    rng = random.Random(3)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", ":", "=", " ", "  ", '"', "'", "abcdef", "ab", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "😀", "\n", ".", "passwd"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["password: token: abcdefg", "x" * 5000 + " token=abcdefgh", "AKIA" + "A" * 16 + "a" * 24]
    found = {r.doc_id: r.s for r in secrets.scan_secrets(docs_of(spark, texts), rules=secrets.BASE_RULES).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()}
    assert [found[i] for i in range(len(texts))] == [",".join(brute_secrets(t)) for t in texts]


def _random_pattern(rng, depth=0):
    """A regular expression that Java and Python read alike."""
    letters = lambda: "".join(rng.choice("abB") for _ in range(rng.randint(1, 4)))
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.randrange(7 if depth < 2 else 3)
        one = letters() if kind < 2 else rng.choice(["[ab]", "[a-z]", ".", "[^a]", r"\b"]) if kind == 2 else f"({_random_pattern(rng, depth + 1)})" if kind < 5 else f"(?:{_random_pattern(rng, depth + 1)}|{_random_pattern(rng, depth + 1)})" if kind == 5 else f"(?i:{letters()})"
        if kind != 2 or one != r"\b":
            one = f"(?:{one})" + rng.choice(["", "", "", "?", "+", "*", "{2}", "{1,3}", "{0,2}"] if depth == 0 or kind < 2 else ["", "?"])
        parts.append(one)
    return "".join(parts)


def test_trigram_queries_lose_no_match():
    rng = random.Random(8)
    seen = 0
    for _ in range(600):
        pattern = _random_pattern(rng)
        query = trigrams.trigram_query(pattern)
        for _ in range(100):
            text = "".join(rng.choice("aaabbbB") for _ in range(rng.randint(0, 12)))
            if (m := re.search(pattern, text)) and query:
                held = m[0].lower()
                assert any(all(g in held for g in branch) for branch in query), (pattern, text, query)
                seen += 1
    assert seen > 300


def test_trigram_queries_are_derived_from_the_pattern():
    assert trigrams.trigram_query("supersecretkey[^a]") == [sorted({"supersecretkey"[i : i + 3] for i in range(12)})]
    assert trigrams.trigram_query("a?bcd(ef|gh)+") == [["bcd", "cde", "def"], ["bcd", "cdg", "dgh"]]
    assert trigrams.trigram_query("(abc)*d") == trigrams.trigram_query("[0-9a-f]{24,}") == trigrams.trigram_query("abc|x") == trigrams.trigram_query(r"\p{L}abc") == []
    assert len(trigrams.trigram_query(secrets.BASE_RULES[0].pattern)) == 6


def test_rules_of_any_kind_equal_a_full_scan(spark):
    rng = random.Random(9)
    rules = [secrets.Rule(f"r{i}", p) for i, p in enumerate(p for p in (_random_pattern(rng) for _ in range(60)) if not re.match(f"(?:{p})$", "") and not re.search(p, "-"))][:12]
    texts = ["".join(rng.choice("aaabbbBc -") for _ in range(rng.randint(0, 16))) for _ in range(150)]
    whole = [[f"{r.kind}:{m.start()}:{m.end()}" for m in re.finditer(r.pattern, t, re.ASCII)] for t in texts for r in rules]
    found = {r.doc_id: r.s or "" for r in secrets.scan_secrets(docs_of(spark, texts), rules=rules).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()}
    for i in range(len(texts)):
        want = sorted(x for one in whole[i * len(rules) : (i + 1) * len(rules)] for x in one)
        assert sorted(filter(None, found[i].split(","))) == want


def test_secrets_beyond_the_broadcast(spark, monkeypatch):
    texts = ["token=abcdefgh", "clean", None, "AKIA" + "A" * 16] * 5
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scan = lambda: Counter((r.doc_id, r.text, r.s) for r in secrets.scan_secrets(docs).select("doc_id", "text", secrets.spans_text(F.col("spans")).alias("s")).collect())
    want = Counter((i, t or "", ",".join(brute_secrets(t or ""))) for i, t in rows)
    assert scan() == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert scan() == want


def test_a_hundred_thousand_secrets_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "".join(f"é {i} password=hunter{i:06d} " for i in range(n)))], "doc_id long, text string")
    began = time.perf_counter()
    found = secrets.scan_secrets(docs, rules=secrets.BASE_RULES)
    row = found.select(F.size("spans").alias("n"), secrets.redact(F.col("text"), F.col("spans")).alias("x")).first()
    assert row.n == n and row.x == "".join(f"é {i} [assign] " for i in range(n))
    assert time.perf_counter() - began < 120


def test_extra_rules_only_add(spark):
    text = "key ghp_" + "a1B2" * 9 + " and password=hunter22"
    rows = secrets.scan_secrets(docs_of(spark, [text])).first()
    assert [s.kind for s in rows.spans] == ["github", "assign"]


def test_redaction(spark):
    rows = secrets.scan_secrets(docs_of(spark, ["a password=hunter22 b", "clean", "ééé token: abcdefgh"]))
    got = [r.x for r in rows.orderBy("doc_id").select(secrets.redact(F.col("text"), F.col("spans")).alias("x")).collect()]
    assert got == ["a [assign] b", "clean", "ééé [assign]"]


def test_redaction_of_overlapping_and_long_spans(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 8)
    monkeypatch.setattr(secrets, "BLOCK", 2)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcé😀") for _ in range(40))
        spans = sorted((a, k, min(40, a + rng.randint(1, 15)), f"k{k}") for k in range(3) for a in rng.sample(range(40), rng.randint(0, 3)))
        out, at = "", 0
        for a, _, b, kind in spans:
            if a >= at:
                out += text[at:a] + f"[{kind}]"
            at = max(at, b)
        rows.append((i, text, spans, out + text[at:]))
    frame = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,ord:int,end:int,kind:string>>, want string")
    assert frame.filter(secrets.redact(F.col("text"), F.col("spans")) != F.col("want")).count() == 0


# 3: decontamination


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words(rng.randint(5, 120)) for _ in range(40)]
    texts, planted = [], set()
    for d in range(120):
        text = words(rng.randint(0, 900))
        if d % 3 == 0:
            item = rng.randrange(40)
            piece = list(items[item])
            if d % 6 == 0 and len(piece) > 60:
                piece[3] = "changed"
            text = text[:50] + piece + text[50:]
            planted.add((d, item))
        texts.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in text) + "!")
    some = max(texts, key=len).lower().strip("!").split()
    short = {90: ["w7"], 91: some[3:5], 92: some[:4], 93: ["w1", "w1", "w1"]}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in (*enumerate(items), *short.items())] + [(None, None), (None, " ".join(items[0])), (94, "")], "item_id long, text string")
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    lower = [re.findall(r"[a-z0-9]+", t.lower()) for t in texts]
    want = {(d, i) for d, t in enumerate(lower) for i, x in enumerate(items) if len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x))}
    assert planted <= want
    long = {d for d, _ in want}
    want |= {(d, None) for d, i in want if i == 0}
    want |= {(d, i) for d, t in enumerate(lower) for i, x in short.items() if any(t[a : a + len(x)] == x for a in range(len(t)))}
    assert {90, 91, 92} <= {i for _, i in want}
    for limit in (decontaminate.BROADCAST_HASHES, 0):  # the broadcast and the shuffled way
        decontaminate.BROADCAST_HASHES, before = limit, decontaminate.BROADCAST_HASHES
        try:
            got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
        finally:
            decontaminate.BROADCAST_HASHES = before
        assert got == want
    left = {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert left == set(range(120)) - long


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(None, f"a {item} b", 1), (None, "clean", 2), (7, item, 3), (7, "other words", 4), (7, item, 3), (8, None, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string")
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        assert {tuple(r) for r in decontaminate.contaminated(docs, items).collect()} == {(None, 1, 1.0), (7, 1, 1.0)}
        assert Counter(map(tuple, decontaminate.decontaminate(docs, items).collect())) == Counter([(None, "clean", 2), (7, "other words", 4), (8, None, 5)])


# 4: tokens


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    table, library = tokens.MergeTable(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(1, 0x600), 0x3000, 0x1F600, 0xAC00, 0x2028]]
    texts = ["".join(rng.choice(chars) if rng.random() < 0.4 else rng.choice(" \n ab'sthe09.,") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [f"a{chr(c)}'t 1{chr(c)}{chr(c)} !{chr(c)}" for c in [*range(1, 0xD800, 7), *range(0xE000, 0x40000, 61), 0x558, 0x208F, 0x11DE0, 0x12550]]
    texts += ["", "a" * 3000, "aaaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "  \n\n  x   "]
    assert tokens.count_texts(texts, table, {}) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


# 5: mixing


def test_targets_are_filled_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    order, weight, size = ["a", "b", "c", "d", None], [5, 2, 1, 5, 2], [10, 1000, 500, 0, 100]
    target, fixed = {}, set()
    while True:
        free = [i for i in range(5) if i not in fixed]
        left = 1.5 * sum(size) - sum(2 * size[i] for i in fixed)
        target = {i: left * weight[i] / sum(weight[j] for j in free) for i in free} | {i: 2 * size[i] for i in fixed}
        over = {i for i in free if target[i] > 2 * size[i]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx({order[i]: float(t) for i, t in target.items()})


def test_mix_comes_near_its_targets_and_repeats(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs)
    taken = rows.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in taken)
    assert rows.filter("copies > 2").count() == 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mixed_documents(docs).count() == rows.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows"])
def test_mix_comes_near_its_targets_whatever_the_ids(spark, kind):
    texts = {"null ids": lambda i: f"w{i} " * 10, "one id": lambda i: f"w{i} " * 10, "equal rows": lambda i: "w " * 10}[kind]
    docs = spark.createDataFrame([(None if kind == "null ids" else 7, texts(i), f"s{i % 3}") for i in range(12_000)], "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix_sources(docs)
    taken = rows.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(taken) == 3 and all(abs(r.taken - r.target) < 0.02 * r.target for r in taken)
    assert rows.filter("copies > 2").count() == 0
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()))


CLASHING = ["__key", "__leak", "__of", "__salt", "__own", "__source", "__of_source", "__kinds", "__items", "__row", "__drop", "size", "target", "copies", "kept", "row", "number", "spans", "lang_pred", "score", "copy_no"]


def test_callers_columns_come_back_whatever_their_names(spark):
    extra = ", ".join(f"{c} int" for c in CLASHING)
    rows = [(i, f"one two three four five number {i % 7} and more words in it", "en", "a" if i % 2 else None, *range(i, i + len(CLASHING))) for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")
    given = {r.doc_id: tuple(r) for r in docs.collect()}
    items = spark.createDataFrame([(1, "one two three four five number 3")], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id: tuple(r) for r in clean.collect()} == {i: r for i, r in given.items() if i % 7 != 3}
    mixed = mixing.mixed_documents(docs)
    assert set(mixed.columns) == {*docs.columns, "copy_no_"}
    assert all(tuple(r[c] for c in docs.columns) == given[r.doc_id] for r in mixed.collect())
    kept = [c for c in CLASHING if c not in ("spans", "score", "lang_pred", "size", "target", "copies")]
    for found in (secrets.scan_secrets(docs, keep=[*kept, "score"]), language.identify_languages(docs, keep=[*kept, "spans"]), mixing.mix_sources(docs, keep=kept)):
        assert all(r[c] == given[r.doc_id][4 + CLASHING.index(c)] for r in found.collect() for c in kept)
    for refused in (lambda: secrets.scan_secrets(docs, keep=["spans"]), lambda: language.identify_languages(docs, keep=["lang_pred"]), lambda: mixing.mix_sources(docs, keep=["size"])):
        with pytest.raises(ValueError):
            refused()


# 6: SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", "one", "Two Words", "three words here", "É a b c É", "a " * 100, "x y z\tw\n" * 50]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", range(6))
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 8), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    far = np.array([bin(int(x)).count("1") for x in a ^ b])
    assert (simhash.within_radius(a, b, radius) == (far <= radius)).all()


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [512, 8])
def test_links_connect_exactly_what_lies_within_the_radius(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = set(map(int, seeds))
    for s in seeds[:6]:  # chains and crowded neighbourhoods
        x = int(s)
        for _ in range(60):
            for k in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(k)
            values.add(x)
    values = sorted(values)
    links = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(values[i] ^ values[j]).count("1") <= 3]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    root = union_find(len(values), links)
    groups = {}
    for v, r in zip(signed, root):
        groups.setdefault(r, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_fingerprints_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 3)
    texts = ["same words as all the others have"] * 6 + ["none"] * 2 + [None, "", "alone in the world"]
    rows = [(i if i not in (2, 6) else None, t) for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter([(None if i == 2 else i, 0) for i in range(6)] + [(None, 7), (7, 7), (8, 8), (9, 8), (10, 10)])


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    root = union_find(len(rows), links)
    least = {}
    for r, row in zip(root, rows):
        least[r] = min(least.get(r, row.doc_id), row.doc_id)
    want = {row.doc_id: (f"{p:016x}", least[r]) for row, p, r in zip(rows, prints, root)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == want


# 7: chats


def test_chats_read_back_exactly(spark):
    rng = random.Random(6)
    parts = ["</s>", "[INST]", "[/INST]", "<s>[", "]\n", "\\", "<", "[", "]", "é", "😀", "plain ", "\n", "assistant", ""]
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "od]d\n<s>", None, ""]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))])))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_chats(frame.orderBy(F.rand(1))).collect()
    assert len(found) == 80
    for r in found:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        assert chat.read_back(r.formatted) == [(x[2] or "", x[3] or "") for x in own]
        assert r.n_turns == len(own)
        assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_start, r.loss_end)] == [x[3] or "" for x in own if x[2] == "assistant"]
        assert "[INST]" not in r.formatted and r.formatted.count("</s>") == len(own)


def test_chats_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(c, t, "user", f"{c}.{t}") for c in (None, 1, 2, 3) for t in range(8)]
        found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.conv_id: [t for _, t in chat.read_back(r.formatted)] for r in found} == {c: [f"{c}.{t}" for t in range(8)] for c in (None, 1, 2, 3)}


def test_chat_query_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    says = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", says), ("assistant", says)]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op7_chat(spark, sf_dir).collect():
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id])))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


# 8: languages


def test_language_accuracy_held_out(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.op8_language(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_texts_without_letters(spark, sf_dir):
    learn = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 + 3 = ½", None)], learn.schema)
    rows = language.identify_languages(learn.unionByName(odd), learn_from=F.col("doc_id") >= 0).filter("doc_id < 0").collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_language_learns_from_null_and_repeated_ids(spark):
    words = {"en": "the of and that with this from have they which", "fr": "le les des une est que qui dans pour avec"}
    rows = [(None, f"{w} {w} {'xyz'[i % 3]}{i}", lang) for lang, w in words.items() for i in range(400)] + [(7, words["en"], "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_sample(docs)
    assert Counter(lang for _, lang in sample) == {"en": language.PER_LANGUAGE, "fr": language.PER_LANGUAGE}
    assert len(set(sample)) == len(sample)
    assert {(r.lang, r.lang_pred) for r in language.identify_languages(docs, keep=["lang"]).distinct().collect()} == {("en", "en"), ("fr", "fr")}


def test_language_learns_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_CHARS", 200)
    words = {"en": "the of and that with this from have they which ", "fr": "le les des une est que qui dans pour avec "}
    docs = spark.createDataFrame([(i, (w * 30 if lang == "en" else w) + f"{i}", lang) for lang, w in words.items() for i in range(40)], "doc_id long, text string, lang string")
    assert all(len(t) <= 200 for t, _ in language.training_sample(docs))
    assert {(r.lang, r.lang_pred) for r in language.identify_languages(docs, keep=["lang"]).distinct().collect()} == {("en", "en"), ("fr", "fr")}


def test_many_languages_keep_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 30)
    monkeypatch.setattr(language, "MAX_TEXTS", 90)
    monkeypatch.setattr(language, "MAX_LANDMARKS", 60)
    rows = [(i, f"{chr(97 + i % 40 % 26)}{chr(97 + i % 40 // 26)} word text {i}", f"l{i % 40:02}") for i in range(800)] + [(1000 + i, "more of it", "l39") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_sample(docs)
    assert len(sample) == 90 and {x for _, x in sample} == {"l39", *(f"l{i:02}" for i in range(29))}
    model = language.fit([t for t, _ in sample], [x for _, x in sample])
    assert len(model.landmarks) == 60 and language.identify_languages(docs).count() == len(rows)


# 9: language model


def test_lm_base_scores_are_exact(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 500)  # so that most words take the joined way
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "the  THE\nunseen-word"), (-2, "the  THE\nunseen-word")], "doc_id long, text string"))
    got = lm.score_documents(docs, learn_from=F.col("doc_id") % 3 != 0).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    texts = [(r.doc_id, [*WORD.findall(lower(r.text)), "\n"]) for r in docs.collect()]
    counts = Counter(w for i, ws in texts if i % 3 != 0 or i == -1 or i == -2 for w in ws)
    total, norm = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    want = sorted((i, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / norm) for w in ws), 6)) for i, ws in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


@pytest.mark.parametrize("texts", [["a b"] * 128 + ["a c"] * 127, ["a b"] * 3 + ["a c", "a d e", "b"], [" ".join(random.Random(i).choices("abcdefgh", k=30)) for i in range(60)]])
def test_lm_probabilities_after_a_context_sum_to_one_at_most(texts):
    tokens = [[*t.split(), "END"] for t in texts]
    words = Counter(w for ws in tokens for w in ws)
    pairs = Counter(p for ws in tokens for p in zip(["END", *ws[:-1]], ws))
    norm = float(sum(words.values()) + len(words) + 1)
    level = lambda n: lm.levels_of(np.array([n])) if n else np.array([0])
    for context in [*words, "unseen"]:
        mass = sum(lm.smoothed_share(level(pairs[context, w]), level(words[context]), level(words[w]), norm)[0] for w in [*words, "unseen"])
        assert 0 < mass <= 1 + 1e-12


def test_lm_scores_use_every_level(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", 20_000, raising=False)  # no such bound decides which levels count
    monkeypatch.setattr(lm, "BATCH_BYTES", 50_000, raising=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) > 0")
    got = {r.doc_id: r.score for r in lm.score_documents(docs.repartition(3), learn_from=F.col("doc_id") % 3 != 0).collect()}
    texts = {r.doc_id: lm.token_hashes(r.text.encode()).tolist() for r in docs.collect()}
    before = {i: [lm._END, *ws[:-1]] for i, ws in texts.items()}
    words = Counter(w for i, ws in texts.items() if i % 3 for w in ws)
    pairs = Counter(p for i, ws in texts.items() if i % 3 for p in zip(before[i], ws))
    norm = sum(words.values()) + len(words) + 1
    level = lambda n: lm.levels_of(np.array([n])) if n else np.array([0])

    def want(i):
        return sum(math.log10(min(lm.smoothed_share(level(pairs[p]), level(words[p[0]]), level(words[p[1]]), norm)[0], 1)) for p in zip(before[i], texts[i]))

    # A learned text's n-grams are members; only levels that a filter holds by mistake set its score apart.
    learned = [i for i in texts if i % 3]
    assert np.mean([abs(got[i] - want(i)) < 0.03 * abs(want(i)) for i in learned]) > 0.9
    assert abs(sum(got.values()) / sum(map(want, texts)) - 1) < 0.05


def test_filters_hold_every_count():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    levels = rng.integers(1, 12, 5000)
    shards = 4
    starts, bits, data, size = np.zeros((2, lm.LEVELS + 2, shards), int), np.zeros((2, lm.LEVELS + 2, shards), int), [], 0
    for shard in range(shards):
        own = lm.shard_of(hashes, shards) == shard
        for level in range(1, 12):
            f = lm.make_filter(hashes[own & (levels >= level)])
            starts[0, level, shard], bits[0, level, shard] = size, len(f) * 8
            data.append(np.frombuffer(f, np.uint8))
            size += len(f)
    filters = lm.Filters(shards, np.concatenate(data), starts, bits, (1, 1))
    found = filters.level(0, hashes)
    assert (found >= levels).all() and (found == levels).mean() > 0.95
    assert (filters.level(0, rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.95


# 10: top-k


@pytest.mark.parametrize("scale", [1, 10_000, 10**12])
def test_topk_matches_brute_force(scale):
    rng = np.random.default_rng(scale)
    weights = rng.integers(-9, 9, (300, 12)) * (rng.random((300, 12)) < 0.4) * scale
    ids = rng.permutation(np.repeat(np.arange(150), 2))
    at, v, s, own = topk.block_best(ids[:40], weights[:40], ids, weights, 20)
    for a in range(40):
        score = lambda b: max(topk.LONG[0], min(topk.LONG[1], sum(int(x) * int(y) for x, y in zip(weights[a], weights[b]))))
        rows = sorted((-score(b), int(ids[b])) for b in range(300))[:20]
        assert sorted(zip((-s[at == a]).tolist(), v[at == a].tolist())) == rows
        assert set(v[(at == a) & own].tolist()) <= {int(ids[a])}


def test_topk_with_few_rows_and_bad_vectors(spark):
    rows = [(1, [1.0, 0.5]), (2, [0.25, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 0.0]), (20, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("weights"))
    got = [tuple(r) for r in topk.exact_topk(vectors.filter("vec_id % 20 = 0"), vectors).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 32 * 16 + 32 * 64), (20, 2, 1, 32 * 64 + 32 * 32)] or got == [(20, 1, 1, 3072), (20, 2, 2, 2560)]


@pytest.mark.parametrize("size", [2**40, 2**61])
def test_topk_scores_beyond_64_bits(size):
    ids, weights = np.arange(4), np.array([[size, size], [size, 1], [-size, -size], [1, 2]], dtype=np.int64)
    _, v, s, own = topk.block_best(ids[:1], weights[:1], ids, weights, 20)
    clip = lambda x: max(topk.LONG[0], min(topk.LONG[1], x))
    want = {b: clip(sum(int(x) * int(y) for x, y in zip(weights[0], weights[b]))) for b in range(4)}
    assert dict(zip(v.tolist(), s.tolist())) == want and v[own].tolist() == [0]


def test_topk_with_one_id_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 8)
    rows = [(1, [i % 5, 1], "x") for i in range(60)] + [(2, [1, 1], "y")] * 30 + [(20, [1, 0], "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, weights array<long>, query_id string").repartition(4)
    got = [(r["rank"], r.vec_id, r.score) for r in topk.exact_topk(vectors.filter("vec_id = 20"), vectors).orderBy("rank").collect()]
    want = sorted(((-w[0], v) for v, w, _ in rows if v != 20))[:20]
    assert got == [(i + 1, v, -s) for i, (s, v) in enumerate(want)]


def test_topk_rows_that_share_the_querys_id_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 4)
    rows = [(20, [3, 1]), (20, [2, 0]), (20, [2, 0]), (40, [1, 1]), (7, [1, 2]), (None, [9, 9]), (8, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, weights array<long>").repartition(3)
    got = Counter(tuple(r) for r in topk.exact_topk(vectors.filter("vec_id % 20 = 0"), vectors, k=3).collect())
    want, usable = Counter(), [(v, w) for v, w in rows if v and w]
    for i, (v, w) in enumerate(usable):
        if v % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, y)), x) for j, (x, y) in enumerate(usable) if j != i)[:3]
            want.update((v, r, x, -s) for r, (s, x) in enumerate(best, 1))
    assert got == want


def test_chats_in_small_buffers_with_clashing_columns(spark, monkeypatch):
    rows = [(c, t, "assistant", f"{c}.{t} " * c, 1, "x") for c in range(12) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    monkeypatch.setattr(chat, "BUFFER", 40)
    assert [(r.conv_id, chat.read_back(r.formatted)) for r in chat.format_chats(frame).orderBy("conv_id").collect()] == [(c, [("assistant", f"{c}.{t} " * c) for t in range(3)]) for c in range(12)]


# Odd tables


def test_odd_documents(spark, odd):
    ids = Counter(r.doc_id for r in odd.collect())
    own = lambda frame, *columns: Counter((r.doc_id, *(r[c] for c in columns)) for r in frame.collect())
    found = secrets.scan_secrets(odd)
    assert own(found) == Counter({(k,): n for k, n in ids.items()}) and [r.doc_id for r in found.filter("size(spans) > 0").collect()] == [6]  # a run of hex digits
    sizes = {None: 0, 1: 0, 2: 0, 3: 0, 4: 8, 5: 180_000, 6: 1}
    assert own(mixing.mix_sources(odd), "size") == Counter({(k, sizes[k]): n for k, n in ids.items()})
    prints = {k: k for k in ids} | {None: 1, 2: 1, 3: 1}  # texts without a word are linked; the null id takes its component's
    assert own(simhash.near_duplicates(odd), "component_id") == Counter({(k, prints[k]): n for k, n in ids.items()})
    lm_rows = lm.score_documents(odd)
    assert own(lm_rows, "n_tokens", "n_known") == Counter({(k, sizes[k] + 1, sizes[k] + 1): n for k, n in ids.items()})
    assert all(math.isfinite(r.score) and r.score <= 0 for r in lm_rows.collect())
    named = {k: "und" if k in (None, 1, 2, 3) else "en" if k in (4, 5) else "de" for k in ids}
    assert own(language.identify_languages(odd), "lang_pred") == Counter({(k, named[k]): n for k, n in ids.items()})
    counts = own(tokens.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json")), "n_bytes")
    assert counts == Counter({(r.doc_id, len((r.text or "").encode())): ids[r.doc_id] for r in odd.collect()})
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()] == [(4, 1)]


def test_empty_documents(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert secrets.scan_secrets(empty).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert tokens.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert language.identify_languages(empty).count() == 0
    assert lm.score_documents(empty).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, weights array<long>")
    assert topk.exact_topk(vectors, vectors).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_crc_split(spark):
    from vellum.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
