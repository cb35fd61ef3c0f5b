"""Results of the rules that follow from their wording, on sentences of our own."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import findings, geometry, keywords, layout, rewrite, score, sections, store
from vellum.operators.lines import classify_lines
from vellum.plans.terms import ROLES, default_terms
from vellum.sources import text as source
from vellum.sources.text import tag_texts

STRENGTH = [
    ("Cut build minutes from 42 to 11 by caching layers.", 1, 1, 1),
    ("Responsible for the nightly import.", 0, 0, 0),
    ("Responsible for store sales.", 0, 0, 1),
    ("Managed vendor contracts during 2021.", 1, 0, 0),
    ("Led three engineers on the mobile app.", 1, 1, 0),
    ("Rolled out version 2.4 to clinics.", 1, 0, 0),
    ("I planned the 3rd annual meetup.", 0, 0, 0),
    ("Kept S3 buckets tidy.", 0, 0, 0),
    ("Supported the help desk.", 0, 0, 0),
    ("Reviewed [[number]] claims per week, [[result: what improved]].", 1, 0, 0),
]


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("x")).first().x


def test_bullet_strength(spark):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STRENGTH)], "i int, text string")
    got = [tuple(r.s)[:3] for r in rows.select("i", T.bullet_strength(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == [s[1:] for s in STRENGTH]


def test_placeholders_count_only_with_credit(spark):
    text = STRENGTH[-1][0]
    assert one(spark, T.bullet_strength(F.col("t"), credit=True)["score"], t=text) == 3
    assert one(spark, T.bullet_strength(F.col("t"))["score"], t=text) == 1


def test_bands(spark):
    assert [one(spark, T.band(F.col("n")), n=n) for n in (49, 50, 70, 85)] == ["filtered", "borderline", "competitive", "strong"]


def test_ordinals(spark):
    assert [one(spark, T.ordinal(F.col("n")), n=n) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]


def test_file_stem(spark):
    assert [one(spark, T.file_stem(F.col("n")), n=n) for n in ("My CV (2).pdf", "...", "a.b.docx")] == ["my-cv-2", "resume", "a-b"]


def test_costs_stop_at_the_cap(spark):
    rows = spark.createDataFrame([("d", "c", "r", i, 5.0, "low", 12.0, i) for i in range(4)], "doc_id string, category string, rule_id string, line_no int, cost double, severity string, cap double, ord long")
    assert [r.cost for r in findings.cap_costs(rows).orderBy("ord").collect()] == [5.0, 5.0, 2.0]


def test_file_kind_by_bytes_then_name(spark):
    files = [(b"%PDF-1.4", "a.txt"), (b"PK\x03\x04", "a.pdf"), (b"hello", "a.MD"), (b"hello", "a.xyz"), (b"", "b.docx")]
    rows = spark.createDataFrame([(bytearray(c), p) for c, p in files], "content binary, path string")
    assert [r.k for r in rows.select(source.file_kind(F.col("content"), F.col("path")).alias("k")).collect()] == ["pdf", "docx", "text", None, "docx"]


def test_scan_keeps_rejected_files(spark, tmp_path):
    (tmp_path / "good.txt").write_text("A line that is certainly longer than forty characters.\r\n")
    (tmp_path / "short.txt").write_text("hi")
    (tmp_path / "odd.bin").write_bytes(b"\0\1")
    rows = source.scan_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows.collect()} == {"good.txt": None, "short.txt": "empty", "odd.bin": "unsupported"}


def test_lines_and_sections(spark):
    text = "Ada Archer\r\nada@mail.example\n\nSummary\nTen years of work on retail data and process design for teams.\nSkills\nPython, SQL\nMY JOURNEY\nData Analyst — Acme, Boston, MA | Jan 2019 – Present\n• Built dashboards\nEducation\nB.S. Economics, State University, 2008"
    lines = source.with_fonts(source.scan_lines(spark.createDataFrame([("d", text)], "doc_id string, text string").withColumn("doc_id", F.lit(1).cast("long"))))
    whole = sections.attach_entries(sections.assign_sections(classify_lines(lines)))
    got = [(r.kind, r.section, r.odd_heading) for r in whole.orderBy("line_no").collect()]
    assert got == [
        ("name", "contact", False), ("contact", "contact", False), ("heading", "summary", False), ("text", "summary", False), ("heading", "skills", False), ("text", "skills", False),
        ("heading", "experience", True), ("entry", "experience", False), ("bullet", "experience", False), ("heading", "education", False), ("entry", "education", False),
    ]
    entries = sections.entry_table(whole).orderBy("entry").collect()
    assert [(e.title, e.org, e.start_year, e.end_open) for e in entries] == [("Data Analyst", "Acme", 2019, True), ("B.S. Economics", "State University", 2008, False)]
    assert sections.years_of_experience(sections.entry_table(whole), 2024).first().years == 5


def test_terms_match_whole_words(spark):
    lines = spark.createDataFrame([(1, 1, "sql, sql mysql c++ C# node React.js reactive"), (1, 2, "R and CRM with machine-learning")], "doc_id int, line_no int, text string")
    got = {(r.line_no, r.term): r.hits for r in keywords.keyword_hits(lines, default_terms(spark)).collect()}
    assert got[1, "sql"] == 2 and got[1, "c++"] == 1 and got[1, "react"] == 1 and got[1, "node.js"] == 1
    assert got[2, "machine learning"] == 1
    assert got[2, "r"] == 2  # also inside an upper-case acronym, as the written pattern has it


def test_implications_are_transitive(spark):
    got = {(r.term, r.implied): r.hops for r in keywords.implications(default_terms(spark)).collect()}
    assert got["jenkins", "ci/cd"] == 1 and got["jenkins", "devops"] == 2


def test_overall_never_exceeds_99(spark):
    rows = [(1, c, 100) for c in findings.WEIGHTS]
    assert score.overall_scores(spark.createDataFrame(rows, "doc_id int, category string, score int")).first().overall == 99


def test_engine_hazards_lower_scores(spark):
    rows = spark.createDataFrame([(1, c, 80) for c in findings.WEIGHTS], "doc_id int, category string, score int")
    hazard = spark.createDataFrame([(1, True, False, False, False, False)], "doc_id int, multi_column boolean, tables boolean, header_contact boolean, images boolean, text_boxes boolean")
    got = {r.engine: r.score for r in score.engine_scores(rows, hazard).collect()}
    assert got == {"workday": 68, "greenhouse": 76, "lever": 74, "taleo": 60}


def test_upper_median_is_an_element(spark):
    rows = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 4.0, 9.0)], "doc_id int, v double")
    assert geometry.upper_median(rows, "v").first().median == 4.0


def test_two_columns_need_a_gap_and_two_blocks(spark):
    left = [(1, i, f"left {i}", 1, 0.06, 0.1 + i * 0.05, 0.3, 0.012, "body") for i in range(8)]
    right = [(1, 20 + i, f"right {i}", 1, 0.6, 0.1 + i * 0.05, 0.3, 0.012, "body") for i in range(8)]
    schema = "doc_id int, stream_index int, text string, page int, x double, y double, w double, h double, source string"
    assert geometry.two_columns(spark.createDataFrame(left + right, schema)).first().columns == 2
    dates = [(*r[:2], "2019 – 2021", *r[3:]) for r in right]
    assert geometry.two_columns(spark.createDataFrame(left + dates, schema)).first().columns == 1


def test_hunks_merge_and_lines_rejoin(spark):
    hunks = spark.createDataFrame([(1, i, k, "a") for i, k in enumerate(["same", "same", "edit", "same"])], "doc_id int, hunk_ord int, kind string, section string")
    assert [(r.kind, r.n) for r in rewrite.merged_runs(hunks).orderBy("hunk_ord").collect()] == [("same", 2), ("edit", 1), ("same", 1)]
    lines = spark.createDataFrame([(1, 1, "A line,"), (1, 2, "that goes on"), (1, 3, "and on."), (1, 4, "Another")], "doc_id int, line_no int, text string")
    assert [r.text for r in rewrite.rejoined(lines).orderBy("line_no").collect()] == ["A line, that goes on and on.", "Another"]


def test_compose_takes_accepted_rewrites_and_values(spark):
    hunks = spark.createDataFrame([(1, 1, True, [1], [1]), (1, 2, False, [2], [2])], "doc_id int, hunk_ord int, accepted boolean, original_lines array<int>, rewrite_lines array<int>")
    lines = spark.createDataFrame([(1, 1, "old one"), (1, 2, "old two")], "doc_id int, line_no int, text string")
    new = spark.createDataFrame([(1, 1, "new [[number]]"), (1, 2, "new two")], "doc_id int, line_no int, text string")
    values = spark.createDataFrame([(1, "number", "7")], "doc_id int, hint string, value string")
    assert rewrite.compose_text(hunks, new, lines, values).first().text == "new 7\nold two"


def test_rewrites_add_no_number_of_their_own(spark):
    old = spark.createDataFrame([(1, 1, "Grew 3 stores in 2019")], "doc_id int, line_no int, text string")
    new = spark.createDataFrame([(1, 1, "Grew 3 stores by 40 since 2019, [[number]]")], "doc_id int, line_no int, text string")
    assert [r.number for r in rewrite.unsupported_numbers(new, old).collect()] == ["40"]


def test_rewritten_bullets(spark):
    cases = {
        "Responsible for building various reports.": "Built reports used by [[number]] people, [[result: what improved and by how much]].",
        "Helped the team with research": "Compiled research ([[quantity or scale]]), [[result: what improved and by how much]].",
        "Worked on customer accounts": "Managed customer accounts across [[number]] accounts, [[result: what improved and by how much]].",
        "Leveraged my dashboards, saving 40 hours": "Used dashboards, saving 40 hours.",
        "Led a dynamic, robust rollout to 3 sites, cutting cost": "Led a rollout to 3 sites, cutting cost.",
    }
    assert {t: one(spark, rewrite.rewritten_bullet(F.col("t")), t=t) for t in cases} == cases
    past = {"managing": "managed", "planning": "planned", "applying": "applied", "building": "built", "making": "made", "Report": "Report"}
    assert {w: one(spark, rewrite.past_tense(F.col("w")), w=w) for w in past} == past
    hints = {"Your Email": "name@example.com", "result: what": "cutting turnaround 30%", "number": "10", "Mon YYYY": "Jan 2020 – Dec 2022"}
    assert {h: one(spark, rewrite.stand_in(F.col("h")), h=h) for h in hints} == hints


def test_claims_are_checked_against_the_original(spark):
    old = spark.createDataFrame([(1, 1, "Grew 3 stores to $1,200 in 2019 with Python, 40 percent up")], "doc_id int, line_no int, text string")
    new = spark.createDataFrame([(1, 1, "Grew 3 stores by 41% to 1200 since 2021 [[12 of 9]]"), (1, 2, "Used Python and Docker for 40%"), (2, 1, "Saved 5k")], "doc_id int, line_no int, text string")
    got = {(r.doc_id, r.line_no): (r.text, r.removed, r.rejected) for r in rewrite.checked_claims(new, old, default_terms(spark)).collect()}
    assert got == {(1, 1): ("Grew 3 stores by [[number]] to 1200 since 2021 [[12 of 9]]", 1, []), (1, 2): ("Used Python and Docker for 40%", 0, ["docker"]), (2, 1): ("Saved [[number]]", 1, [])}
    claims = spark.createDataFrame([(1, "a", "stores  TO $1,200"), (1, "b", "3 st"), (1, "c", "never said")], "doc_id int, term string, evidence string")
    assert [r.term for r in rewrite.quoted_evidence(claims, old).collect()] == ["a"]


def test_skills_are_grouped(spark):
    few = [(1, i, x) for i, x in enumerate(["SQL", "sql ", "Excel", "Team player", ""])]
    many = [(2, i, x) for i, x in enumerate(["Python", "Java", "C++", "SQL", "Databases", "Docker", "Kubernetes", "React", "Node", "Excel", "Juggling"])]
    got = [(r.doc_id, r.label, r.text) for r in rewrite.grouped_skills(spark.createDataFrame(few + many, "doc_id int, ord int, item string"), default_terms(spark)).orderBy("doc_id", "ord").collect()]
    assert got == [(1, "Skills", "SQL, Excel"), (2, "Languages", "Python, Java, C++"), (2, "Data", "SQL, Databases"), (2, "Infrastructure", "Docker, Kubernetes"), (2, "Also", "React, Node, Excel, Juggling")]
    shown = {"ci/cd": "CI/CD", "machine learning": "Machine Learning", "client/server": "Client/Server"}
    assert {t: one(spark, rewrite.shown_term(F.col("t")), t=t) for t in shown} == shown


def test_rebuilt_documents_keep_their_lineage(spark, sf_dir):
    from vellum.plans.tables import corpus_model

    m = corpus_model(spark, sf_dir)
    new = rewrite.rebuilt(m.lines, m.entries, default_terms(spark))
    used = new.select("doc_id", F.explode("origins").alias("line_no")).distinct()
    assert m.lines.filter("not opens").join(used, ["doc_id", "line_no"], "left_anti").count() == 0
    assert new.groupBy("doc_id", "line_no").count().filter("count > 1").count() == 0
    assert new.filter("kind = 'heading' and text = 'My Journey'").count() == 0


def test_context_and_presets(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc_id int")
    described = spark.createDataFrame([(1, 100, 3), (2, 50, 9)], "doc_id int, length int, n_keywords int")
    chosen, guess = spark.createDataFrame([(2, "nurse"), (3, "astronaut")], "doc_id int, role string"), spark.createDataFrame([(4, "data-analyst")], "doc_id int, role string")
    got = {r.doc_id: (r.kind, r.role) for r in keywords.choose_context(docs, described, chosen, guess, ROLES).collect()}
    assert got == {1: ("description", None), 2: ("role", "nurse"), 3: ("role", "general"), 4: ("inferred", "data-analyst")}
    preset = {r.term: r.category for r in keywords.preset_keywords({"x": ((), (("ml", 2), ("sql", 3), ("welding", 1)))}, default_terms(spark)).collect()}
    assert preset == {"machine learning": "data", "sql": "data", "welding": "role"}


LAYOUT_ITEM = "doc_id int, stream_index int, text string, page int, x double, y double, w double, h double, source string, table_id string, row int, col int"


def test_regions_by_place(spark):
    rows = [(1, 0, "Ada Archer", 1, 0.1, 0.02, 0.2, 0.01), (1, 1, "Ada Archer", 2, 0.1, 0.02, 0.2, 0.01), (1, 2, "Once only", 3, 0.1, 0.02, 0.2, 0.01), (1, 3, "a@b.example", 3, 0.5, 0.02, 0.2, 0.01), (1, 4, "2", 2, 0.5, 0.96, 0.1, 0.01), (1, 5, "Body text at the foot", 2, 0.5, 0.96, 0.1, 0.01), (1, 6, "odd", 1, float("nan"), 0.5, 7.0, 0.01)]
    items = spark.createDataFrame([(*r, "body", None, None, None) for r in rows], LAYOUT_ITEM)
    got = {r.stream_index: (r.source, r.x, r.w) for r in layout.with_regions(items).collect()}
    assert [got[i][0] for i in range(7)] == ["header", "header", "body", "header", "footer", "body", "body"] and got[6][1:] == (0.0, 1.0)


def test_lost_contact_and_portfolio(spark):
    line = "doc_id int, line_no int, text string, source string"
    body = spark.createDataFrame([(1, 1, "Ada", "body"), (2, 1, "call 212 555 0100", "body"), (3, 1, "Bo", "body")], line)
    contact = spark.createDataFrame([(i, None, None, p, None, None, None, None) for i, p in ((1, None), (2, "212 555 0100"), (3, None))], "doc_id int, name string, email string, phone string, location string, linkedin string, github string, website string")
    items = [(1, 0, "a@b.example", 1, 0.1, 0.02, 0.2, 0.01, "header", None, None, None), (2, 0, "(212) 555-0100", 1, 0.1, 0.96, 0.2, 0.01, "footer", None, None, None), (3, 0, "github.com/bo", 1, 0.1, 0.3, 0.2, 0.01, "textbox", None, None, None)]
    files = spark.createDataFrame([(i, "pdf", 10, 1) for i in (1, 2, 3)], "doc_id int, file_type string, file_size int, declared_columns int")
    lay = layout.Layout(spark.createDataFrame(items, LAYOUT_ITEM), spark.createDataFrame([], "doc_id int, page int, description string"), files)
    matches = spark.createDataFrame([(i, "git", 1, 0) for i in (1, 2, 3)], "doc_id int, term string, weight int, hits int")
    m = findings.Model(body, None, contact, None, matches, lay)
    assert {(r.doc_id, r.rule_id) for r in findings.lost_contact_findings(m).collect()} == {(1, "email-in-header"), (3, "github-in-textbox")}
    known = {r.doc_id: (r.email, r.phone, r.github, r.asks_portfolio) for r in findings.known_contact(m).collect()}
    assert known == {1: ("a@b.example", None, None, True), 2: (None, "212 555 0100", None, True), 3: (None, None, "github.com/bo", True)}


def test_records_replace_share_and_change_hands(spark, tmp_path):
    path = str(tmp_path / "kv")
    store.put(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), path, "anonymous")
    store.put(spark.createDataFrame([("a", 3)], "id string, v int"), path, "saved")
    assert {(r.kind, r.key, r.v) for r in store.current(spark.read.parquet(path)).collect()} == {("anonymous", "a", 1), ("anonymous", "b", 2), ("saved", "a", 3)}
    store.put(spark.createDataFrame([("b", 5)], "id string, v int"), path, "anonymous")
    assert {r.v for r in store.current(spark.read.parquet(path)).filter("kind = 'anonymous'").collect()} == {1, 5}
    entries = spark.createDataFrame([("k", i, str(i)) for i in range(6)], "key string, seq int, value string")
    assert [r.value for r in store.ranged(entries, 1, 3).orderBy("place").collect()] == ["4", "3", "2"]
    shares = store.share_tokens(spark.createDataFrame([("d1",)], "id string"), "s", F.lit("2024-01-01").cast("timestamp"))
    token = shares.first().token
    asked = spark.createDataFrame([(token,), ("no",)], "token string")
    at = lambda day: {r.token: r.id for r in store.resolve_tokens(asked, shares, F.lit(day).cast("timestamp")).collect()}
    assert at("2024-01-20") == {token: "d1", "no": None} and at("2024-03-01") == {token: None, "no": None}
    rows = spark.createDataFrame([("s1", None, 1), ("s2", None, 2)], "session_id string, owner_uid string, n int").withColumn("expires_at", F.lit("2020-01-01").cast("timestamp"))
    got = {r.session_id: (r.owner_uid, r.late) for r in store.reown(rows, spark.createDataFrame([("s1", "u")], "session_id string, uid string")).withColumn("late", F.col("expires_at") > F.current_timestamp()).collect()}
    assert got == {"s1": ("u", True), "s2": (None, False)}
    hits = spark.createDataFrame([("k", 10), ("k", 3599), ("k", 3600)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.bucket, r.n) for r in store.counters(hits, 3600).collect()) == [(0, 2), (1, 1)]
    patched = store.overlay(rows.select("session_id", "n"), spark.createDataFrame([("s2", 9)], "session_id string, n int"), ["session_id"])
    assert {(r.session_id, r.n) for r in patched.collect()} == {("s1", 1), ("s2", 9)}


def test_entities_and_quoted_tags(spark):
    html = '<p title="a > b">one &#65;&#x1F600; &amp;lt; <b class="x>y">two</b></p>'
    assert one(spark, tag_texts(F.col("t"), "p"), t=html) == ["one A😀 &lt; two"]


def test_compare_runs_fills_missing_categories(spark):
    a = spark.createDataFrame([(1, "x", 5)], "doc_id int, category string, score int")
    b = spark.createDataFrame([(1, "y", 7)], "doc_id int, category string, score int")
    assert {(r.category, r.delta) for r in store.compare_runs(a, b).collect()} == {("x", -5), ("y", 7)}


def test_records_expire(spark, tmp_path):
    path = str(tmp_path / "records")
    store.append_records(spark.range(2), path, "anonymous")
    rows = spark.read.parquet(path)
    assert store.live(rows).count() == 2
    assert store.live(rows, F.timestamp_add("DAY", F.lit(8), F.current_timestamp())).count() == 0


def test_dates_take_one_form(spark):
    forms = {"January 2019 – present": "Jan 2019 – Present", "3/19 - 11/2020": "Mar 2019 – Nov 2020", "Fall 2018": "Fall 2018", "2017": "2017", "Sept. '08 until 2010": "Sep 2008 – 2010", "": "[[Mon YYYY – Mon YYYY]]"}
    assert {d: one(spark, rewrite.normal_dates(F.col("d")), d=d) for d in forms} == forms


def test_headlines_and_summaries(spark):
    schema = "doc_id long, entry int, section string, dates string, title string, org string"
    entries = spark.createDataFrame([(1, 1, "experience", "5/2019 – now", "Nurse", "Acme"), (1, 2, "experience", None, None, "Globex"), (1, 3, "education", "2008", None, None)], schema)
    assert [r.text for r in rewrite.headlines(entries).orderBy("entry").collect()] == ["Nurse — Acme | May 2019 – Present", "[[Job title]] — Globex | [[Mon YYYY – Mon YYYY]]", "[[Degree — School]] | 2008"]
    lines = spark.createDataFrame([(1, 5, "skills", "text", "Python, SQL, Excel")], "doc_id long, line_no int, section string, kind string, text string")
    years = spark.createDataFrame([(1, 5)], "doc_id long, years int")
    assert rewrite.summaries(lines, entries, years).first().text == "Nurse with 5+ years across Acme and Globex; hands-on with Python, SQL and Excel."
