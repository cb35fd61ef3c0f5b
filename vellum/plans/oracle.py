"""SQL twins of the registered queries, for comparison with another engine.

Shared common table expressions are composed by `sql`; patterns come from the same constants
as the DataFrame expressions.
"""

from __future__ import annotations

import re

from vellum.functions import patterns as P
from vellum.functions.tokens import pads
from vellum.plans.corpus import CORPUS_SQL, EVENT_JSON, LAYOUT_SQL
from vellum.operators.score import ENGINES
from vellum.operators.wrap import ARROWS, BULLETS, OTHER, WIDTHS
from vellum.plans.terms import DEFAULT, DEFAULT_TARGETS, TOKEN_KEY

SPECIAL = ("c", "r", "go")


def lit(text: str) -> str:
    return "'" + text.replace(P.WORD_EDGE, r"\b").replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def extract(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({column}, {lit(pattern)}, {group})"


def removed(column: str, *patterns: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, {lit(p)}, '', 'g')"
    return column


def _metric(column: str) -> str:
    rest = removed(column, P.PLACEHOLDER, *P.NOT_METRIC)
    return f"({matches(rest, r'\d')} OR ({matches(rest, P.NUMBER_WORD)} AND {matches(rest, P.COUNTABLE)}))"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '\\S+'))"


_FIRST = "regexp_replace(lower(regexp_extract(trim({c}), '^(\\S*)', 1)), '[^a-z]', '', 'g')"
_BARE = f"regexp_replace(text, {lit(P.PLACEHOLDER)}, ' ', 'g')"
_VERB_TEXT = f"regexp_replace(trim({_BARE}), '^[^a-zA-Z]+', '')"
_VERB_WORD = _FIRST.format(c=_VERB_TEXT)
_VERB = (
    f"CASE WHEN {_VERB_TEXT} = '' OR {matches(_VERB_TEXT, P.WEAK_START)} THEN 0 "
    f"WHEN {_VERB_WORD} IN ({', '.join(map(lit, P.STRONG_IRREGULAR))}) OR ({_VERB_WORD} LIKE '%ed' AND length({_VERB_WORD}) > 3) OR {matches(_VERB_WORD, P.BASE_VERB)} THEN 1 ELSE 0 END"
)
_SHAPE = " || ".join(f"CASE WHEN {matches('text', p)} THEN '{m}' ELSE 'x' END" for p, m in P.SKELETON)

_STRIP = "regexp_replace({0}, '^[•➢] ', '')"


def _column_ctes(item: str, prefix: str) -> dict[str, str]:
    """Bands, the longest gap of each page, and whether it parts two columns, over a table of items."""
    return {
        f"{prefix}hist": f"SELECT doc_id, page, bin, count(*) AS n FROM (SELECT doc_id, page, unnest(range(floor(x * 100)::INT, greatest(floor(x * 100)::INT, least(99, ceil((x + w) * 100)::INT)) + 1)) AS bin FROM {item} WHERE source = 'body' AND w > 0) GROUP BY doc_id, page, bin",
        f"{prefix}band": f"SELECT doc_id, page, items, unnest(range(20, 81)) AS bin FROM (SELECT doc_id, page, count(*) AS items FROM {item} WHERE source = 'body' AND w > 0 GROUP BY doc_id, page)",
        f"{prefix}gap": f"""SELECT doc_id, page, start, width FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY width DESC, start) AS k FROM (
  SELECT doc_id, page, min(bin) AS start, count(*) AS width FROM (SELECT doc_id, page, bin, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS island FROM {prefix}band LEFT JOIN {prefix}hist USING (doc_id, page, bin) WHERE coalesce(n, 0) <= items * 0.05) GROUP BY doc_id, page, island)) WHERE k = 1""",
        f"{prefix}col": f"""SELECT doc_id, page, divider, CASE WHEN count(*) >= 8 AND count(CASE WHEN NOT r THEN 1 END) >= 5 AND count(CASE WHEN r THEN 1 END) >= 5 AND stddev_pop(CASE WHEN r THEN x END) <= 0.04 AND avg(CASE WHEN r THEN (NOT dated)::INT END) >= 0.4
    AND least(max(CASE WHEN NOT r THEN y + h END), max(CASE WHEN r THEN y + h END)) - greatest(min(CASE WHEN NOT r THEN y END), min(CASE WHEN r THEN y END)) >= 0.2 THEN 2 ELSE 1 END AS columns
  FROM (SELECT i.*, g.divider, i.x >= g.divider AS r, {matches("i.text", P.DATE_RANGE)} OR {matches("i.text", P.YEAR)} AS dated FROM {item} i JOIN (SELECT doc_id, page, (start + width / 2.0)::DOUBLE / 100 AS divider FROM {prefix}gap WHERE width >= 3) g USING (doc_id, page) WHERE i.source = 'body' AND i.w > 0) GROUP BY doc_id, page, divider""",
    }


CTE = {
    # Lines of the documents table.
    "doc_line": r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, t AS text FROM (
  SELECT doc_id, unnest(range(len(r))) AS pos, unnest(r) AS t FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS r FROM documents)) WHERE t <> ''""",
    "corpus": CORPUS_SQL,
    # The derived corpus: headings are known, so sections and work lines follow from their positions.
    "bounds": """SELECT doc_id, min(CASE WHEN text IN ('Experience', 'MY JOURNEY') THEN line_no END) AS exp_at, coalesce(min(CASE WHEN text = 'Education' THEN line_no END), 1000000) AS edu_at,
  min(CASE WHEN text = 'Skills' THEN line_no END) AS skills_at, min(CASE WHEN text IN ('Summary', 'Objective') THEN line_no END) AS sum_at,
  bool_or(regexp_matches(text, '^[A-Z]+( [A-Z]+){1,4}$') AND length(text) < 40 AND lower(text) NOT IN ('experience', 'education', 'skills', 'summary', 'objective')) AS odd FROM corpus GROUP BY doc_id""",
    "exp_line": f"""SELECT c.doc_id, c.line_no, c.text AS raw, {_STRIP.format('c.text')} AS text, {matches('c.text', '^[•➢] ')} AS is_bullet, (NOT {matches('c.text', '^[•➢] ')}) AND {matches("c.text", P.DATE_RANGE)} AS dated
  FROM corpus c JOIN bounds b USING (doc_id) WHERE c.line_no > b.exp_at AND c.line_no < b.edu_at""",
    # A short undated line before a dated one starts its entry; one between a dated line and a bullet completes the header.
    "exp_mark": """SELECT *, coalesce(NOT is_bullet AND NOT dated AND lead(dated) OVER w, false) AS pre, coalesce(NOT is_bullet AND NOT dated AND lag(dated) OVER w AND lead(is_bullet) OVER w, false) AS post
  FROM exp_line WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
    "exp_entry": "SELECT *, dated OR pre OR post AS is_header, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM (SELECT *, pre OR (dated AND NOT coalesce(lag(pre) OVER (PARTITION BY doc_id ORDER BY line_no), false)) AS fresh FROM exp_mark)",
    "work": "SELECT doc_id, line_no, text, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN entry > 0 THEN 0 ELSE 1 END, line_no) AS pos FROM exp_entry WHERE NOT is_header AND (entry > 0 OR is_bullet)",
    "strength": f"SELECT doc_id, line_no, pos, {_VERB} AS verb, {_metric('text')}::INT AS metric, {matches(_BARE, P.OUTCOME)}::INT AS outcome FROM work",
    # Experience prose: work lines, and lines before the first dated entry.
    "exp_prose": "SELECT doc_id, line_no, text FROM exp_entry WHERE NOT is_header",
    "sum_prose": "SELECT c.doc_id, c.line_no, c.text FROM corpus c JOIN bounds b USING (doc_id) WHERE c.line_no = b.sum_at + 1",
    "edu_prose": "SELECT c.doc_id, c.line_no, c.text FROM corpus c JOIN bounds b USING (doc_id) WHERE c.line_no > b.edu_at + 1",
    "prose": "SELECT * FROM exp_prose UNION ALL SELECT * FROM sum_prose UNION ALL SELECT * FROM edu_prose",
    "term_form": "SELECT * FROM (VALUES "
    + ", ".join(f"({lit(t)}, {lit(f)})" for t, _, aliases, _ in DEFAULT if t not in SPECIAL for f in (t, *aliases))
    + ") AS v(term, form)",
    "hit": r"""SELECT doc_id, line_no, term, len(regexp_extract_all(d, pat)) AS hits FROM (SELECT doc_id, line_no, regexp_replace(lower(regexp_replace(text, '^[•➢] ', '')), '([^a-z0-9+#])', '\1\1', 'g') AS d FROM corpus),
  (SELECT term, '(?:' || string_agg('(^|[^a-z0-9])' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(form, '([.*?^${}()|\[\]\\/])', '\\\1\\\1', 'g'), '\+', '\\+', 'g'), '\\\.\\\.js$', '(?:\\.\\.js|js)?'), ' ', '[\\s-]{2}', 'g') || '([^a-z0-9+#]|$)', '|') || ')' AS pat FROM term_form GROUP BY term) WHERE regexp_matches(d, pat)""",
    "implies": "SELECT * FROM (VALUES " + ", ".join(f"({lit(t)}, {lit(i)})" for t, _, _, implied in DEFAULT for i in implied) + ") AS v(term, implied)",
    "target": "SELECT * FROM (VALUES " + ", ".join(f"({lit(t)}, {w})" for t, w in DEFAULT_TARGETS) + ") AS v(term, weight)",
    # The case-sensitive terms may stand inside longer words: not beside a-z or 0-9, nor + or # after.
    "all_hit": "SELECT doc_id, line_no, term, sum(hits) AS hits FROM (SELECT doc_id, line_no, term, hits FROM hit UNION ALL "
    + " UNION ALL ".join(
        f"SELECT doc_id, line_no, '{term}', len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(form)}) = '{form}' AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(text, i + {len(form)}, 1), '[a-z0-9+#]'))) FROM corpus WHERE text LIKE '%{form}%'"
        for term, form in (("r", "R"), ("c", "C"), ("go", "Go"), ("go", "Golang"), ("go", "golang"))
    )
    + ") GROUP BY doc_id, line_no, term HAVING sum(hits) > 0",
    "doc_hit": "SELECT doc_id, term, sum(hits) AS hits, count(*) AS n_lines FROM all_hit GROUP BY doc_id, term",
    "doc_words": f"SELECT doc_id, count(*) AS n_lines, sum({_words(_STRIP.format('text'))}) AS words FROM corpus GROUP BY doc_id",
    "keyword_score": """SELECT d.doc_id, greatest(0, floor(round(100.0 * sum(CASE WHEN h.term IS NULL THEN 0 ELSE t.weight END) / sum(t.weight))
    - least(9, 3 * count(CASE WHEN h.hits > greatest(4, round(greatest(50, d.words) / 120.0)) THEN 1 END)) + 0.5)) AS score
  FROM doc_words d CROSS JOIN target t LEFT JOIN doc_hit h ON h.doc_id = d.doc_id AND h.term = t.term GROUP BY d.doc_id""",
    "impact_score": "SELECT doc_id, least(CASE WHEN count(*) < 3 THEN 60 ELSE 100 END, floor(sum(verb + metric + outcome) / (3.0 * count(*)) * 100 + 0.5)) AS score FROM strength GROUP BY doc_id",
    "headed": f"""SELECT doc_id, entry, bool_or(dated) AS dated, max(CASE WHEN dated THEN {extract('raw', P.DATE_RANGE)} ELSE '' END) AS dates, count(CASE WHEN NOT is_header THEN 1 END) AS n_bullets FROM exp_entry WHERE entry > 0 GROUP BY doc_id, entry""",
    "structure_score": f"""SELECT b.doc_id, greatest(0, 100 - (CASE WHEN b.edu_at = 1000000 THEN 15 ELSE 0 END + CASE WHEN b.skills_at IS NULL THEN 15 ELSE 0 END + CASE WHEN b.odd THEN 8 ELSE 0 END
    + CASE WHEN coalesce(h.forms, 0) > 1 THEN 5 ELSE 0 END + least(10, 5 * coalesce(h.n_empty, 0)) + CASE WHEN o.doc_id IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN r.doc_id IS NOT NULL THEN 3 ELSE 0 END
    + CASE WHEN w.n_lines > 110 THEN 8 WHEN w.words > 950 AND coalesce(y.years, 0) < 8 THEN 4 ELSE 0 END + CASE WHEN w.words < 120 THEN 12 WHEN w.words < 200 THEN 6 ELSE 0 END + CASE WHEN e.doc_id IS NULL THEN 30 ELSE 0 END)) AS score
  FROM bounds b JOIN doc_words w USING (doc_id)
  LEFT JOIN (SELECT DISTINCT doc_id FROM exp_entry) e USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT CASE WHEN regexp_matches(dates, '\\d{{1,2}}/\\d{{2,4}}') THEN 'numeric' WHEN regexp_matches(dates, '(?i)[a-z]{{3,}}\\.?\\s*''?\\d{{2,4}}') THEN 'month-year' ELSE 'year' END) AS forms, count(CASE WHEN n_bullets = 0 THEN 1 END) AS n_empty FROM headed GROUP BY doc_id) h USING (doc_id)
  LEFT JOIN (SELECT DISTINCT doc_id FROM corpus WHERE text = 'Objective') o USING (doc_id)
  LEFT JOIN (SELECT DISTINCT doc_id FROM corpus WHERE {matches("text", P.REFERENCES)}) r USING (doc_id)
  LEFT JOIN (SELECT doc_id, greatest(0, max(CASE WHEN {matches(extract('raw', P.DATE_RANGE, 2), P.OPEN_END)} THEN 2024 ELSE regexp_extract({extract('raw', P.DATE_RANGE, 2)}, '((?:19|20)\\d{{2}})', 1)::INT END) - min(regexp_extract({extract('raw', P.DATE_RANGE, 1)}, '((?:19|20)\\d{{2}})', 1)::INT)) AS years FROM exp_entry WHERE dated GROUP BY doc_id) y USING (doc_id)""",
    "opener": f"SELECT doc_id, {_FIRST.format(c='text')} AS word, count(*) AS n, arg_min({matches('trim(text)', P.WEAK_START)}, pos) AS weak FROM work GROUP BY doc_id, word",
    "writing_cost": " UNION ALL ".join([
        f"SELECT doc_id, least(40, 8 * count(*)) AS cost FROM work WHERE {matches('trim(text)', P.WEAK_START)} GROUP BY doc_id",
        f"SELECT doc_id, least(15, 3 * count(*)) FROM prose WHERE {matches('text', P.FILLER)} GROUP BY doc_id",
        f"SELECT doc_id, least(9, 3 * count(*)) FROM prose WHERE {matches('text', P.PASSIVE)} GROUP BY doc_id",
        f"SELECT doc_id, 5 FROM prose WHERE {matches('text', P.FIRST_PERSON)} GROUP BY doc_id",
        f"SELECT doc_id, 5 FROM sum_prose WHERE {matches('text', P.SEEKING)} GROUP BY doc_id",
        "SELECT doc_id, least(12, 4 * count(*)) FROM opener WHERE word <> '' AND n >= 3 AND NOT weak GROUP BY doc_id",
        "SELECT doc_id, least(24, 4 * sum(n)) FROM (SELECT doc_id, " + " + ".join(f"{matches('text', p)}::INT" for _, p in P.GENERIC) + " AS n FROM prose) GROUP BY doc_id HAVING sum(n) > 0",
    ]),
    "writing_score": "SELECT d.doc_id, greatest(0, 100 - coalesce(sum(w.cost), 0)) AS score FROM doc_words d LEFT JOIN writing_cost w USING (doc_id) GROUP BY d.doc_id",
    "contact_score": f"""SELECT doc_id, greatest(0, 100 - (CASE WHEN NOT {matches('text', P.EMAIL)} THEN CASE WHEN lost_email THEN 12 ELSE 30 END ELSE 0 END + CASE WHEN NOT {matches('text', P.PHONE)} THEN CASE WHEN lost_phone THEN 8 ELSE 20 END ELSE 0 END + CASE WHEN NOT {matches('text', r'linkedin\.com')} THEN 12 ELSE 0 END
    + CASE WHEN placed THEN 0 ELSE 15 END + CASE WHEN {matches(f"split_part({extract('text', P.EMAIL)}, '@', 1)", P.EMAIL_TONE)} THEN 5 ELSE 0 END)) AS score
  FROM (SELECT c.doc_id, bool_or(coalesce(l.email, false)) AS lost_email, bool_or(coalesce(l.phone, false)) AS lost_phone, coalesce(string_agg(CASE WHEN {matches('c.text', P.EMAIL)} OR {matches('c.text', P.PHONE)} OR {matches('c.text', r'linkedin\.com')} THEN c.text END, chr(10) ORDER BY c.line_no), '') AS text, bool_or((c.line_no <= 6 OR c.line_no < b.first_at) AND place <> '' AND NOT {matches('place', P.TITLE)} AND NOT {matches('place', P.DEGREE)}) AS placed
    FROM (SELECT *, coalesce(nullif({extract('bare', P.STRICT_LOCATION)}, ''), {extract('bare', P.LOCATION)}) AS place FROM (SELECT *, {_STRIP.format('text')} AS bare FROM corpus)) c JOIN (SELECT doc_id, least(exp_at, coalesce(sum_at, 1000000), coalesce(skills_at, 1000000)) AS first_at FROM bounds) b USING (doc_id) LEFT JOIN lost l USING (doc_id) GROUP BY c.doc_id)""",
    **_column_ctes("item", "i_"),
    **{f"l_{name}": sql for name, sql in LAYOUT_SQL.items()},
    **_column_ctes("l_items", "l_"),
    "l_cols": "SELECT f.doc_id, greatest(1, coalesce(max(c.columns), 1), any_value(f.declared_columns))::INT AS columns FROM l_files f LEFT JOIN l_col c USING (doc_id) GROUP BY f.doc_id",
    "l_moved": """SELECT doc_id, count(*) AS n, count(CASE WHEN abs(s - p) > 6 THEN 1 END) AS moved FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stream_index) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, stream_index) AS p FROM l_items WHERE source = 'body') GROUP BY doc_id""",
    "l_loose": f"SELECT doc_id, source AS kind, count(*) AS n, bool_or({matches('text', P.EMAIL)}) AS email, bool_or({matches('text', P.PHONE)}) AS phone FROM l_items WHERE source IN ('header', 'footer', 'textbox') GROUP BY doc_id, source",
    "l_table": "SELECT doc_id, table_id, count(*) AS n, count(DISTINCT col) AS cols FROM l_items WHERE table_id IS NOT NULL GROUP BY doc_id, table_id",
    "l_page": "SELECT doc_id, page, count(*) AS n, bool_or(description LIKE '%vector%') AS vector FROM l_images GROUP BY doc_id, page",
    "glyph": f"SELECT c.doc_id, bool_or(c.line_no < least(b.exp_at, coalesce(b.sum_at, 1000000), coalesce(b.skills_at, 1000000))) AS contact FROM corpus c JOIN bounds b USING (doc_id) WHERE {matches('c.text', P.GLYPH_ISSUE)} GROUP BY c.doc_id",
    "parse_cost": """SELECT doc_id, 'multi-column' AS rule_id, 30.0 AS cost, 1 AS n FROM l_cols WHERE columns > 1
  UNION ALL SELECT doc_id, 'table', least(30, 10 * count(*)), least(3, count(*)) FROM l_table GROUP BY doc_id
  UNION ALL SELECT doc_id, 'header-text', CASE WHEN email OR phone THEN 15 ELSE 5 END, 1 FROM l_loose WHERE kind = 'header'
  UNION ALL SELECT doc_id, 'footer-text', CASE WHEN email OR phone THEN 8 ELSE 2 END, 1 FROM l_loose WHERE kind = 'footer'
  UNION ALL SELECT doc_id, 'textbox', 12, 1 FROM l_loose WHERE kind = 'textbox'
  UNION ALL SELECT doc_id, CASE WHEN vector THEN 'vector-graphics' ELSE 'image' END, 5 * count(*), count(*) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM l_page) WHERE k <= 3 GROUP BY doc_id, vector
  UNION ALL SELECT m.doc_id, 'stream-order', 8, 1 FROM l_moved m JOIN l_cols USING (doc_id) WHERE columns = 1 AND n > 10 AND moved > n * 0.25
  UNION ALL SELECT doc_id, 'file-size', 5, 1 FROM l_files WHERE file_size > 2097152
  UNION ALL SELECT doc_id, 'glyphs', CASE WHEN contact THEN 8 ELSE 5 END, 1 FROM glyph
  UNION ALL SELECT DISTINCT doc_id, 'symbol-bullets', 3, 1 FROM corpus WHERE text LIKE '➢ %'""",
    "parse_score": "SELECT d.doc_id, greatest(0, floor(100 - coalesce(sum(p.cost), 0) + 0.5)) AS score FROM doc_words d LEFT JOIN parse_cost p USING (doc_id) GROUP BY d.doc_id",
    "body_contact": f"SELECT doc_id, bool_or({matches('text', P.EMAIL)}) AS email, bool_or({matches('text', P.PHONE)}) AS phone FROM corpus GROUP BY doc_id",
    "lost": "SELECT b.doc_id, bool_or(l.email AND NOT b.email) AS email, bool_or(l.phone AND NOT b.phone) AS phone FROM body_contact b JOIN l_loose l USING (doc_id) GROUP BY b.doc_id",
    "hazard": """SELECT c.doc_id, columns > 1 AS multi_column, t.doc_id IS NOT NULL AS tables, coalesce(l.email OR l.phone, false) AS header_contact, p.doc_id IS NOT NULL AS images, x.doc_id IS NOT NULL AS text_boxes
  FROM l_cols c LEFT JOIN (SELECT DISTINCT doc_id FROM l_table) t USING (doc_id) LEFT JOIN lost l USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM l_page) p USING (doc_id) LEFT JOIN (SELECT doc_id FROM l_loose WHERE kind = 'textbox') x USING (doc_id)""",
    "score": " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, score FROM {t}_score" for c, t in (("parse", "parse"), ("keywords", "keyword"), ("impact", "impact"), ("structure", "structure"), ("writing", "writing"), ("contact", "contact"))),
    "request": "SELECT event_type AS kind, user_id AS identity, ts, event_id FROM events",
    # Forty parts make a document of two pages, so documents grow in number with the table.
    "item": """SELECT p_partkey // 40 AS doc_id, CAST(p_partkey AS INT) AS stream_index, CASE WHEN p_partkey % 13 = 0 THEN 'Yearly report' ELSE p_name END AS text, CAST(1 + (p_partkey // 20) % 2 AS INT) AS page,
  CAST(CASE WHEN p_partkey % 7 < 4 OR (p_partkey // 40) % 6 = 0 THEN 0.06 ELSE 0.60 END AS DOUBLE) AS x, CAST(0.02 + (p_partkey % 13) * 0.06 AS DOUBLE) AS y,
  CAST(0.05 + (p_size % 30) * 0.01 AS DOUBLE) AS w, CAST(0.012 AS DOUBLE) AS h, CASE WHEN p_partkey % 41 = 0 THEN 'header' ELSE 'body' END AS source,
  CASE WHEN p_partkey % 10 = 3 THEN 'T1' END AS table_id, CAST((p_partkey // 20) % 2 AS INT) AS "row", CAST(p_partkey % 3 AS INT) AS col FROM part""",
}
NEEDS = {
    **{f"{p}{n}": tuple(f"{p}{x}" if x != "item" else i for x in needs) for p, i in (("l_", "l_items"), ("i_", "item")) for n, needs in (("hist", ("item",)), ("band", ("item",)), ("gap", ("band", "hist")), ("col", ("item", "gap")))},
    "l_cols": ("l_files", "l_col"), "l_moved": ("l_items",), "l_loose": ("l_items",), "l_table": ("l_items",), "l_page": ("l_images",), "glyph": ("corpus", "bounds"), "body_contact": ("corpus",), "lost": ("body_contact", "l_loose"),
    "parse_cost": ("l_cols", "l_table", "l_loose", "l_page", "l_moved", "l_files", "glyph", "corpus"), "parse_score": ("doc_words", "parse_cost"), "hazard": ("l_cols", "l_table", "lost", "l_page", "l_loose"),
    "bounds": ("corpus",), "exp_line": ("corpus", "bounds"), "exp_mark": ("exp_line",), "exp_entry": ("exp_mark",), "work": ("exp_entry",), "strength": ("work",), "exp_prose": ("exp_entry",),
    "sum_prose": ("corpus", "bounds"), "edu_prose": ("corpus", "bounds"), "prose": ("exp_prose", "sum_prose", "edu_prose"), "hit": ("corpus", "term_form"),
    "all_hit": ("corpus", "hit"), "doc_hit": ("all_hit",), "doc_words": ("corpus",), "keyword_score": ("doc_words", "target", "doc_hit"), "impact_score": ("strength",), "headed": ("exp_entry",),
    "structure_score": ("bounds", "doc_words", "exp_entry", "headed"), "opener": ("work",), "writing_cost": ("work", "prose", "opener"), "writing_score": ("doc_words", "writing_cost"),
    "contact_score": ("corpus", "bounds", "lost"), "score": ("parse_score", "keyword_score", "impact_score", "structure_score", "writing_score", "contact_score"),
}

#: Placeholders that the asked bullets get, as text, and what stands in for them.
_NUMBER_ASKED, _RESULT_ASKED = " ([[quantity or scale]])", ", [[result: what improved and by how much]]"
CTE |= {
    "ask": f"""SELECT *, text || CASE WHEN metric = 0 THEN {lit(_NUMBER_ASKED)} ELSE '' END || CASE WHEN outcome = 0 THEN {lit(_RESULT_ASKED)} ELSE '' END AS composed
  FROM (SELECT w.doc_id, w.line_no, w.text, s.verb, s.metric, s.outcome FROM work w JOIN strength s USING (doc_id, line_no) JOIN exp_entry e USING (doc_id, line_no) WHERE e.is_bullet AND s.verb + s.metric + s.outcome < 3)""",
    "ask_words": f"SELECT d.doc_id, d.n_lines, d.words + coalesce(a.more, 0) AS words FROM doc_words d LEFT JOIN (SELECT doc_id, sum({_words('composed')} - {_words('text')}) AS more FROM ask GROUP BY doc_id) a USING (doc_id)",
    "ask_new": f"""SELECT v.*, {_metric('new')}::INT + regexp_matches(regexp_replace(new, {lit(P.PLACEHOLDER)}, ' ', 'g'), {lit(P.OUTCOME)})::INT + verb AS now, b.n_lines, b.words - {_words('composed')} + {_words('new')} AS words FROM (
    SELECT doc_id, line_no, 'quantity or scale' AS hint, verb, verb + metric + outcome AS old, composed, replace(composed, '[[quantity or scale]]', '10') AS new FROM ask WHERE metric = 0
    UNION ALL SELECT doc_id, line_no, 'result: what improved and by how much', verb, verb + metric + outcome, composed, replace(composed, '[[result: what improved and by how much]]', 'cutting turnaround 30%') FROM ask WHERE outcome = 0) v JOIN ask_words b USING (doc_id)""",
    "words_at": "SELECT DISTINCT doc_id, n_lines, words FROM (SELECT doc_id, n_lines, words FROM ask_words UNION ALL SELECT doc_id, n_lines, words FROM ask_new)",
    # Scores that depend on the number of words, for each number that a variant has.
    "structure_at": CTE["structure_score"].replace("SELECT b.doc_id,", "SELECT b.doc_id, w.words,", 1).replace("JOIN doc_words w", "JOIN words_at w"),
    "keyword_at": CTE["keyword_score"].replace("SELECT d.doc_id,", "SELECT d.doc_id, d.words,", 1).replace("FROM doc_words d", "FROM words_at d").replace("GROUP BY d.doc_id", "GROUP BY d.doc_id, d.words"),
    "text_parse": "SELECT d.doc_id, 100 - coalesce(sum(p.cost), 0) AS score FROM doc_words d LEFT JOIN (SELECT * FROM parse_cost WHERE rule_id IN ('glyphs', 'symbol-bullets')) p USING (doc_id) GROUP BY d.doc_id",
    "text_contact": CTE["contact_score"].replace("lost_email THEN", "false THEN").replace("lost_phone THEN", "false THEN"),
    "ask_sum": "SELECT doc_id, count(*) AS n, sum(verb + metric + outcome) AS s FROM strength GROUP BY doc_id",
    "gain": """SELECT doc_id, line_no, hint, round(greatest(0, round((fixed + later) / 100, 1) - round((fixed + earlier) / 100, 1)), 1) AS gain FROM (SELECT v.doc_id, v.line_no, v.hint,
    (25 * p.score + 10 * w.score + 5 * c.score)::DOUBLE AS fixed,
    (25 * k1.score + 15 * s1.score + 20 * least(CASE WHEN i.n < 3 THEN 60 ELSE 100 END, floor((i.s - v.old + v.now) / (3.0 * i.n) * 100 + 0.5)))::DOUBLE AS later,
    (25 * k0.score + 15 * s0.score + 20 * least(CASE WHEN i.n < 3 THEN 60 ELSE 100 END, floor(i.s / (3.0 * i.n) * 100 + 0.5)))::DOUBLE AS earlier
  FROM ask_new v JOIN ask_words b USING (doc_id) JOIN ask_sum i USING (doc_id) JOIN text_parse p USING (doc_id) JOIN writing_score w USING (doc_id) JOIN text_contact c USING (doc_id)
  JOIN keyword_at k1 ON k1.doc_id = v.doc_id AND k1.words = v.words JOIN structure_at s1 ON s1.doc_id = v.doc_id AND s1.words = v.words
  JOIN keyword_at k0 ON k0.doc_id = v.doc_id AND k0.words = b.words JOIN structure_at s0 ON s0.doc_id = v.doc_id AND s0.words = b.words)""",
}
NEEDS |= {
    "ask": ("work", "strength", "exp_entry"), "ask_words": ("doc_words", "ask"), "ask_new": ("ask", "ask_words"), "words_at": ("ask_words", "ask_new"), "structure_at": ("bounds", "words_at", "exp_entry", "headed"), "keyword_at": ("words_at", "target", "doc_hit"),
    "text_parse": ("doc_words", "parse_cost"), "text_contact": ("corpus", "bounds", "lost"), "ask_sum": ("strength",), "gain": ("ask_new", "ask_words", "ask_sum", "text_parse", "writing_score", "text_contact", "keyword_at", "structure_at"),
}

CTE["text_score"] = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, floor(score + 0.5)::INT AS score FROM {t}" for c, t in (("parse", "text_parse"), ("keywords", "keyword_score"), ("impact", "impact_score"), ("structure", "structure_score"), ("writing", "writing_score"), ("contact", "text_contact")))
NEEDS["text_score"] = ("text_parse", "keyword_score", "impact_score", "structure_score", "writing_score", "text_contact")

CTE |= {
    # On the derived pages items of one height are one row, and one line if no divider parts them; tables are read where the file is in document order.
    "v_item": "SELECT i.*, f.file_type = 'pdf' AS positioned, CASE WHEN c.columns = 2 AND i.x >= c.divider THEN 1 ELSE 0 END AS side FROM l_items i JOIN l_files f USING (doc_id) LEFT JOIN l_col c USING (doc_id, page)",
    "v_line": "SELECT doc_id, source, table_id, row_no, stream_index, text, x, y, page, positioned, side, concat_ws('/', page, source, side, y) AS line FROM v_item",
    "v_row": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y) AS row_no, text, n_lines, lines, mangled FROM (
    SELECT doc_id, page, y, trim(string_agg(trim(text), ' ' ORDER BY x)) AS text, count(DISTINCT line) AS n_lines, list(DISTINCT line) AS lines, count(DISTINCT side) > 1 AS mangled FROM v_line WHERE positioned AND source = 'body' GROUP BY doc_id, page, y)
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at), text, n_lines, lines, mangled FROM (
    SELECT doc_id, min(stream_index) AS first_at, string_agg(trim(text), ' ' ORDER BY stream_index) AS text, count(DISTINCT line) AS n_lines, list(DISTINCT line) AS lines, count(DISTINCT col) > 1 AS mangled FROM (SELECT v.*, i.col FROM v_line v JOIN l_items i USING (doc_id, stream_index, source))
    WHERE NOT positioned AND source IN ('body', 'table') GROUP BY doc_id, CASE WHEN table_id IS NULL THEN stream_index::VARCHAR ELSE table_id || ':' || row_no END)""",
    # Patience piles: the number of piles is the longest run that is in order.
    "v_moved": """SELECT doc_id, len(s) - len(list_reduce(list_prepend([]::INT[], list_transform(s, lambda v: [v])), lambda piles, v: list_concat(list_append(list_filter(piles, lambda p: p < v[1]), v[1]), list_filter(piles, lambda p: p >= v[1])[2:]))) AS n_moved
  FROM (SELECT doc_id, list(at_index ORDER BY page, side, y) AS s FROM (SELECT doc_id, page, side, y, min(stream_index)::INT AS at_index FROM v_line WHERE source = 'body' GROUP BY doc_id, page, side, y) GROUP BY doc_id)""",
}
NEEDS |= {"v_item": ("l_items", "l_files", "l_col"), "v_line": ("v_item",), "v_row": ("v_line", "l_items"), "v_moved": ("v_line",)}


def closure(*ctes: str) -> list[str]:
    """The expressions and those they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for c in ctes:
        add(c)
    return order


def _of_export(names: list[str]) -> None:
    """The same expressions over the exported lines, with x_ before their names: headings in capitals, a dash for a bullet."""
    heads = ("Experience", "Education", "Skills", "Summary", "Objective")
    shown = f"CASE WHEN text IN ({', '.join(map(lit, heads))}) THEN upper(text) WHEN {matches('text', '^[•➢] ')} THEN '- ' || substr(text, 3) ELSE text END"
    for n in names:
        body = re.sub(rf"\b({'|'.join(names)})\b", r"x_\1", CTE[n])
        for h in heads:
            body = body.replace(lit(h), lit(h.upper()))
        CTE[f"x_{n}"] = f"SELECT doc_id, line_no, {shown} AS text FROM corpus" if n == "corpus" else body.replace("[•➢] ", "- ")
        NEEDS[f"x_{n}"] = ("corpus",) if n == "corpus" else tuple(f"x_{x}" if x in names else x for x in NEEDS.get(n, ()))


_of_export([n for n in closure("text_score") if "corpus" in closure(n)])


def sql(body: str, *ctes: str) -> str:
    """The statement with the expressions it names and those they need, in order."""
    order = closure(*ctes)
    recursive = "RECURSIVE " if "closure" in body else ""
    return "WITH " + recursive + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + body


def capped(found: str, cost: float, cap: float, *ctes: str) -> str:
    """Costs of one rule by document, kept in order until the cap."""
    body = f""", f AS ({found}), c AS (SELECT doc_id, line_no, coalesce(sum({cost}) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f)
SELECT doc_id, count(*) AS n, round(sum(least({cost}, {cap} - prior))::DOUBLE, 1) AS cost FROM c WHERE prior < {cap} GROUP BY doc_id"""
    return sql(body, *ctes)


_CATEGORY = "CASE WHEN {0} < 50 THEN 'filtered' WHEN {0} < 70 THEN 'borderline' WHEN {0} < 85 THEN 'competitive' ELSE 'strong' END"

_WEIGHT = "CASE category WHEN 'parse' THEN {0} WHEN 'keywords' THEN {1} WHEN 'impact' THEN {2} WHEN 'structure' THEN {3} WHEN 'writing' THEN {4} ELSE {5} END"
_OVERALL = f", o AS (SELECT doc_id, sum(score * {_WEIGHT.format(25, 25, 20, 15, 10, 5)}) / 100.0 AS raw FROM score GROUP BY doc_id)"

_INNER, _OUTER = (p.hex() for p in pads(TOKEN_KEY))
_SIGNATURE = "sha256(unhex('{1}') || unhex(sha256(unhex('{0}') || encode(body))))".format(_INNER, _OUTER)

_GLYPH = f"CASE WHEN ord(c) BETWEEN 32 AND {31 + len(WIDTHS)} THEN [{', '.join(map(str, WIDTHS))}][ord(c) - 31] ELSE {OTHER} END"

SQL = {
    # Words one after the other: rows so far, width of the open row, words of the first row.
    "q_wrapped_lines": sql(
        f""", w AS (SELECT doc_id, line_no, list_filter(string_split_regex(regexp_replace(regexp_replace(translate(text, '{BULLETS}', '----'), '{ARROWS}', '->', 'g'), '[^\\x{{20}}-\\x{{7E}}\\x{{A0}}-\\x{{FF}}–—‘’“”•…‰€™]', '', 'g'), '\\s+'), lambda x: x <> '') AS words FROM doc_line),
s AS (SELECT doc_id, line_no, words, list_transform(words, lambda x: [0, list_sum(list_transform(string_split(x, ''), lambda c: {_GLYPH})), 0]::BIGINT[]) AS sizes FROM w),
f AS (SELECT *, list_reduce(list_prepend([1, -{WIDTHS[0]}, 0]::BIGINT[], sizes), lambda a, x: CASE WHEN a[2] < 0 OR a[2] + {WIDTHS[0]} + x[2] <= 20000 THEN [a[1], a[2] + {WIDTHS[0]} + x[2], a[3] + (a[1] = 1)::INT] ELSE [a[1] + 1, x[2], a[3]] END) AS r FROM s)
SELECT doc_id, line_no::INT AS line_no, r[1]::INT AS n_rows, array_to_string(words[1:r[3]], ' ') AS first_row FROM f""",
        "doc_line",
    ),
    "q_event_errors": f"""WITH j AS (SELECT {EVENT_JSON} AS t FROM events), v AS (SELECT t, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t ELSE '{{}}' END::JSON AS d FROM j),
k AS (SELECT ok, d, CASE WHEN ok AND d->>'$.type' IN ('stage', 'finding', 'aggregate', 'done') THEN d->>'$.type' END AS kind FROM v),
e AS (SELECT coalesce(kind, '?') AS kind, list_filter([CASE WHEN NOT ok THEN '$ syntax' WHEN kind IS NULL THEN '$.type kind' END] || CASE kind
  WHEN 'stage' THEN [CASE WHEN d->>'$.stage' NOT IN ('parse', 'keywords', 'impact', 'structure', 'writing', 'contact', 'aggregate', 'plan') THEN '$.stage value' END]
  WHEN 'finding' THEN [CASE WHEN json_type(d, '$.finding') IS NULL THEN '$.finding missing' END, CASE WHEN json_type(d, '$.finding.id') IS NULL THEN '$.finding.id missing' END, CASE coalesce(json_type(d, '$.finding.severity'), '') WHEN '' THEN '$.finding.severity missing' WHEN 'VARCHAR' THEN NULL ELSE '$.finding.severity type' END]
  WHEN 'aggregate' THEN [CASE WHEN json_type(d, '$.overallScore') = 'NULL' THEN '$.overallScore missing' END]
  WHEN 'done' THEN [CASE WHEN json_type(d, '$.aiUsed') <> 'BOOLEAN' THEN '$.aiUsed type' END] ELSE [] END, lambda x: x IS NOT NULL) AS errors FROM k)
SELECT kind, coalesce(split_part(error, ' ', 1), '') AS path, coalesce(split_part(error, ' ', 2), 'valid') AS reason, count(*) AS n FROM (SELECT kind, unnest(CASE WHEN len(errors) = 0 THEN [NULL] ELSE errors END) AS error FROM e) GROUP BY 1, 2, 3""",
    "q_feed_marks": """WITH f AS (SELECT user_id::VARCHAR AS analysis_id, event_id AS seq, CASE WHEN event_type = 'signup' AND value > 100 THEN 'reset' WHEN event_type = 'purchase' THEN 'resolved' ELSE 'finding' END AS type, event_id % 17 AS key, (floor(value) % 5)::INT AS line_no, CASE WHEN value > 60 THEN 3 WHEN value > 20 THEN 2 ELSE 1 END AS rank, event_type AS category FROM events),
r AS (SELECT analysis_id, max(seq) AS reset FROM f WHERE type = 'reset' GROUP BY analysis_id),
k AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, key ORDER BY seq DESC) AS k FROM f WHERE type <> 'reset')
SELECT analysis_id, line_no, max(rank)::INT AS rank, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM k LEFT JOIN r USING (analysis_id) WHERE k = 1 AND type = 'finding' AND seq > coalesce(reset, -1) GROUP BY analysis_id, line_no""",
    "q_replaced_order": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id))::INT AS place FROM events GROUP BY user_id, event_type",
    "q_change_log": """WITH h AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS hunk_ord, l_partkey % 3 = 0 AS edit, l_returnflag AS section, l_linestatus = 'F' AS accepted FROM lineitem)
SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY min(hunk_ord))::INT AS place, count(*) AS n, count(CASE WHEN accepted THEN 1 END) AS n_accepted FROM h WHERE edit GROUP BY doc_id, section""",
    "q_signed_tokens": f"""SELECT o_orderkey, body || '.' || {_SIGNATURE} AS token, CASE WHEN o_orderkey % 800 > 365 THEN o_orderkey::VARCHAR END AS subject FROM (SELECT o_orderkey, base64(encode(o_orderkey::VARCHAR)) || '.' || ((o_orderdate::DATE - DATE '1970-01-01') * 86400 + (o_orderkey % 800) * 86400) AS body FROM orders)""",
    "q_export": sql(
        f""" SELECT doc_id, string_agg(CASE WHEN text IN ('Experience', 'MY JOURNEY', 'Education', 'Skills', 'Summary', 'Objective') THEN chr(10) || upper(text) WHEN {matches('text', '^[•➢] ')} THEN '- ' || substr(text, 3) ELSE text END, chr(10) ORDER BY line_no) AS text FROM corpus GROUP BY doc_id""",
        "corpus",
    ),
    "q_reading_issues": sql(
        """ SELECT doc_id, kind, sum(n)::BIGINT AS n FROM (SELECT r.doc_id, 'column-interleave' AS kind, count(*) AS n FROM (SELECT doc_id, page, y, count(DISTINCT side) AS sides FROM v_item WHERE source = 'body' AND positioned GROUP BY doc_id, page, y) r JOIN l_cols c USING (doc_id) WHERE sides > 1 AND c.columns > 1 GROUP BY r.doc_id
UNION ALL SELECT doc_id, 'column-interleave', columns FROM l_cols JOIN l_files USING (doc_id) WHERE columns > 1 AND file_type <> 'pdf'
UNION ALL SELECT doc_id, 'table-flatten', cols FROM l_table WHERE cols > 1 UNION ALL SELECT m.doc_id, 'out-of-order', moved FROM l_moved m JOIN l_cols USING (doc_id) WHERE columns = 1 AND n > 10 AND moved > n * 0.25) GROUP BY doc_id, kind""",
        "v_item", "l_cols", "l_files", "l_table", "l_moved",
    ),
    "q_page_elements": r"""SELECT page_id, lower(regexp_extract(t, '^<([^\s/>]+)', 1)) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[?!][^>]*>|<(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS t FROM pages)
WHERE NOT regexp_matches(t, '^<[!?/]') GROUP BY 1, 2""",
    "q_machine_rows": sql(" SELECT doc_id, row_no::INT AS row_no, text, n_lines::INT AS n_lines, mangled FROM v_row", "v_row"),
    "q_machine_view": sql(
        """, w AS (SELECT doc_id, count(*) AS n_rows, count(CASE WHEN mangled THEN 1 END) AS n_mangled FROM v_row GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT line) AS n_scrambled FROM (SELECT doc_id, unnest(lines) AS line FROM v_row WHERE mangled) GROUP BY doc_id),
l AS (SELECT doc_id, count(DISTINCT line) AS n_lines, count(DISTINCT CASE WHEN source IN ('header', 'footer', 'textbox') THEN line END) AS n_lost FROM v_line GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_rows, 0) AS n_rows, coalesce(n_mangled, 0) AS n_mangled, coalesce(n_lost, 0) AS n_lost, coalesce(n_scrambled, 0) AS n_scrambled, coalesce(n_moved, 0) AS n_moved
FROM l_files f LEFT JOIN l USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN v_moved USING (doc_id)""",
        "v_row", "v_moved", "v_line", "l_files",
    ),
    "q_unread_words": sql(
        """, a AS (SELECT doc_id, unnest(string_split(trim(text), ' ')) AS word, 1 AS n FROM v_line UNION ALL SELECT doc_id, unnest(string_split(text, ' ')), -1 FROM v_row)
SELECT doc_id, word, sum(n)::BIGINT AS n FROM a WHERE word <> '' GROUP BY doc_id, word HAVING sum(n) > 0""",
        "v_line", "v_row",
    ),
    "q_round_trip": sql(
        f""" SELECT c.doc_id, count(CASE WHEN lower({_STRIP.format('c.text')}) = lower(regexp_replace(x.text, '^- ', '')) THEN 1 END) AS n_same, 0::BIGINT AS n_moved, count(CASE WHEN lower({_STRIP.format('c.text')}) <> lower(regexp_replace(x.text, '^- ', '')) THEN 1 END) AS n_changed,
0::BIGINT AS n_lost, 0::BIGINT AS n_added, count(CASE WHEN {matches('c.text', '^[•➢] ')} <> {matches('x.text', '^- ')} THEN 1 END) AS n_kind, 0::BIGINT AS n_section FROM corpus c JOIN x_corpus x USING (doc_id, line_no) GROUP BY c.doc_id""",
        "x_corpus",
    ),
    "q_round_trip_scores": sql(" SELECT b.doc_id, b.category, b.score AS before, a.score AS after FROM text_score b JOIN x_text_score a USING (doc_id, category)", "text_score", "x_text_score"),
    "q_asked_gains": sql(" SELECT doc_id, line_no, hint, gain FROM gain", "gain"),
    "q_gain_totals": sql(" SELECT doc_id, count(*) AS n_placeholders, count(*) AS n_unfilled, round(sum(gain), 1)::DOUBLE AS total_gain FROM gain GROUP BY doc_id", "gain"),
    "q_overall": sql(f"{_OVERALL} SELECT doc_id, round(raw, 1)::DOUBLE AS raw_total, least(99, floor(raw + 0.5))::INT AS overall, {_CATEGORY.format('least(99, floor(raw + 0.5))')} AS band FROM o", "score"),
    "q_category_scores": sql(" SELECT doc_id, category, score::INT AS score FROM score", "score"),
    "q_engines": sql(
        ", p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS engine, sum(score * {_WEIGHT.format(*w)}) / {sum(w)}.0 AS part FROM score GROUP BY doc_id" for e, (w, _) in ENGINES.items())
        + "), f AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {', '.join(map(str, h.values()))})" for e, (_, h) in ENGINES.items()) + f") AS v(engine, {', '.join(f'f_{h}' for h in ENGINES['workday'][1])}))"
        + " SELECT p.doc_id, p.engine, greatest(0, least(99, floor(round(part::DOUBLE" + "".join(f" * CASE WHEN h.{h} THEN f_{h}::DOUBLE ELSE 1 END" for h in ENGINES["workday"][1]) + ", 9) + 0.5)))::INT AS score FROM p JOIN f USING (engine) JOIN hazard h ON h.doc_id = p.doc_id",
        "score", "hazard",
    ),
    "q_hazards": sql(" SELECT * FROM hazard", "hazard"),
    "q_two_columns": sql(" SELECT doc_id, page, divider, columns::INT AS columns FROM i_col", "i_col"),
    "q_parse_rules": sql(" SELECT doc_id, rule_id, sum(n)::BIGINT AS n, round(sum(cost)::DOUBLE, 1) AS cost FROM parse_cost GROUP BY doc_id, rule_id", "parse_cost"),
    "q_dropped": sql(
        """ SELECT doc_id, kind, '' AS place, n, CASE WHEN kind = 'textbox' OR email OR phone THEN 'high' ELSE 'low' END AS severity FROM l_loose UNION ALL SELECT doc_id, 'table', table_id, n, 'high' FROM l_table
UNION ALL SELECT doc_id, CASE WHEN vector THEN 'vector' ELSE 'image' END, page::VARCHAR, n, 'low' FROM l_page UNION ALL SELECT c.doc_id, 'column', '', (SELECT count(*) FROM l_items i JOIN l_col p USING (doc_id, page) WHERE i.doc_id = c.doc_id AND p.columns = 2 AND i.source = 'body' AND i.x >= p.divider), 'high' FROM l_cols c WHERE columns > 1""",
        "l_loose", "l_table", "l_page", "l_cols", "l_col",
    ),
    "q_layout": sql(
        f""", w AS (SELECT doc_id, sum({_words(_STRIP.format('text'))})::BIGINT AS words FROM corpus GROUP BY doc_id), i AS (SELECT doc_id, count(DISTINCT table_id) AS n_tables, count(table_id) AS n_cells, count(CASE WHEN source = 'textbox' THEN 1 END) AS n_boxes,
  coalesce(string_agg(CASE WHEN source = 'header' THEN text END, ' · ' ORDER BY stream_index), '') AS header_text, coalesce(string_agg(CASE WHEN source = 'footer' THEN text END, ' · ' ORDER BY stream_index), '') AS footer_text FROM l_items GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n_images FROM l_images GROUP BY doc_id)
SELECT c.doc_id, c.columns, coalesce(n_tables, 0) AS n_tables, coalesce(n_cells, 0) AS n_cells, coalesce(n_boxes, 0) AS n_boxes, coalesce(header_text, '') AS header_text, coalesce(footer_text, '') AS footer_text, coalesce(n_images, 0) AS n_images, coalesce(words, 0) AS words FROM l_cols c LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN w USING (doc_id)""",
        "l_cols", "l_items", "l_images", "corpus",
    ),
    "q_weak_spots": sql(
        f""", l AS (SELECT doc_id, category, ((100 - score) * {_WEIGHT.format(25, 25, 20, 15, 10, 5)} / 100.0)::DOUBLE AS lost FROM score WHERE score < 90), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lost DESC, category DESC)::INT AS rank FROM l)
SELECT doc_id, category, lost, rank FROM k WHERE rank <= 3""",
        "score",
    ),
    "q_line_scan": sql(f" SELECT doc_id, count(*) AS n_lines, sum({_words('text')})::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars, greatest(1, ceil(count(*) / 55.0))::BIGINT AS pages FROM doc_line GROUP BY doc_id", "doc_line"),
    "q_contact_lines": sql(
        f" SELECT doc_id, min(CASE WHEN {matches('text', P.EMAIL)} THEN line_no END)::INT AS email_line, min(CASE WHEN {matches('text', P.PHONE)} THEN line_no END)::INT AS phone_line, "
        f"arg_min({extract('text', P.EMAIL)}, CASE WHEN {matches('text', P.EMAIL)} THEN line_no END) AS email FROM doc_line GROUP BY doc_id HAVING count(CASE WHEN {matches('text', P.EMAIL)} OR {matches('text', P.PHONE)} THEN 1 END) > 0",
        "doc_line",
    ),
    "q_metric_lines": sql(f" SELECT doc_id, count(*) AS n_metric FROM doc_line WHERE {_metric('text')} GROUP BY doc_id", "doc_line"),
    "q_first_person": sql(f" SELECT doc_id, min(line_no)::INT AS line_no FROM doc_line WHERE {matches('text', P.FIRST_PERSON)} GROUP BY doc_id", "doc_line"),
    "q_acronyms": r"""SELECT doc_id, candidate, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\b[A-Z][A-Z0-9+#.]{1,7}\b'), regexp_extract_all(text, '\b[A-Z][a-z]+(?:\.[a-z]+|[A-Z][a-z]+)+\b'))) AS candidate FROM documents)
WHERE NOT regexp_matches(candidate, '^(AND|OR|THE|US|USA|UK|EU|PM|AM|NYC|LA|SF|DC|ID|OK|NO|YES|TBD|PTO|K|M|B)$') GROUP BY doc_id, candidate""",
    "q_page_tags": r"""SELECT page_id, coalesce(regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1)[1], '') AS raw_h1, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1))::INT AS n_links, len(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1))::INT AS n_paragraphs FROM pages""",
    "q_bullet_strength": sql(" SELECT doc_id, line_no, verb, metric, outcome, verb + metric + outcome AS score FROM strength", "strength"),
    "q_impact": sql(" SELECT doc_id, count(*) AS n_bullets, round(sum(verb + metric + outcome) / (3.0 * count(*)), 6) AS mean, sum(metric)::BIGINT AS with_number, sum(verb)::BIGINT AS with_verb FROM strength GROUP BY doc_id", "strength"),
    "q_weak_openers": capped(f"SELECT doc_id, line_no, pos AS ord FROM work WHERE {matches('trim(text)', P.WEAK_START)}", 8, 40, "work"),
    "q_filler": capped(f"SELECT doc_id, line_no, line_no AS ord FROM prose WHERE {matches('text', P.FILLER)}", 3, 15, "prose"),
    "q_generic_phrases": capped(
        " UNION ALL ".join(f"SELECT doc_id, line_no, line_no * 100 + {i} AS ord FROM prose WHERE {matches('text', p)}" for i, (_, p) in enumerate(P.GENERIC)), 4, 24, "prose"
    ),
    "q_repeated_openers": sql(
        f""", w AS (SELECT doc_id, line_no, pos, {_FIRST.format(c='text')} AS word, {matches('trim(text)', P.WEAK_START)} AS weak FROM work), g AS (SELECT doc_id, word, count(*) AS n, arg_min(weak, pos) AS weak, list(line_no ORDER BY pos)[3] AS third FROM w WHERE word <> '' GROUP BY doc_id, word)
SELECT doc_id, word, n, third::INT AS third FROM g WHERE n >= 3 AND NOT weak""",
        "work",
    ),
    "q_shapes": sql(f" SELECT doc_id, {_SHAPE} AS shape, count(*) AS n FROM work GROUP BY doc_id, shape", "work"),
    "q_keyword_hits": sql(" SELECT doc_id, term, hits::BIGINT AS hits, n_lines FROM doc_hit", "doc_hit"),
    "q_match_percent": sql(
        ", present AS (SELECT doc_id, term FROM doc_hit) SELECT d.doc_id, round(100.0 * sum(CASE WHEN p.term IS NULL THEN 0 ELSE t.weight END) / sum(t.weight))::INT AS percent FROM (SELECT DISTINCT doc_id FROM corpus) d, target t LEFT JOIN present p ON p.doc_id = d.doc_id AND p.term = t.term GROUP BY d.doc_id",
        "doc_hit", "target",
    ),
    "q_overused": sql(
        f""", h AS (SELECT doc_id, term, hits FROM doc_hit), n AS (SELECT doc_id, sum({_words(_STRIP.format('text'))}) AS words FROM corpus GROUP BY doc_id)
SELECT doc_id, term, hits::BIGINT AS hits, greatest(4, round(greatest(50, words) / 120.0))::INT AS most FROM h JOIN target USING (term) JOIN n USING (doc_id) WHERE hits > greatest(4, round(greatest(50, words) / 120.0))""",
        "doc_hit", "target",
    ),
    "q_implications": sql(
        " , closure AS (SELECT term, implied, 1 AS hops FROM implies UNION ALL SELECT c.term, i.implied, c.hops + 1 FROM closure c JOIN implies i ON c.implied = i.term WHERE c.hops < 3) SELECT term, implied, min(hops)::INT AS hops FROM closure GROUP BY term, implied",
        "implies",
    ),
    "q_supported": sql(
        """, closure AS (SELECT term, implied, 1 AS hops FROM implies UNION ALL SELECT c.term, i.implied, c.hops + 1 FROM closure c JOIN implies i ON c.implied = i.term WHERE c.hops < 3), present AS (SELECT doc_id, term FROM doc_hit),
missing AS (SELECT d.doc_id, t.term, t.weight FROM (SELECT DISTINCT doc_id FROM corpus) d, target t WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.doc_id = d.doc_id AND p.term = t.term))
SELECT m.doc_id, m.term, m.weight::INT AS weight, string_agg(DISTINCT p.term, ',' ORDER BY p.term) AS supported_by FROM missing m LEFT JOIN closure c ON c.implied = m.term LEFT JOIN present p ON p.doc_id = m.doc_id AND p.term = c.term GROUP BY m.doc_id, m.term, m.weight""",
        "doc_hit", "target", "implies",
    ),
    "q_missing_ranks": sql(
        """, closure AS (SELECT term, implied, 1 AS hops FROM implies UNION ALL SELECT c.term, i.implied, c.hops + 1 FROM closure c JOIN implies i ON c.implied = i.term WHERE c.hops < 3), present AS (SELECT doc_id, term FROM doc_hit),
missing AS (SELECT d.doc_id, t.term, t.weight FROM (SELECT DISTINCT doc_id FROM corpus) d, target t WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.doc_id = d.doc_id AND p.term = t.term)),
held AS (SELECT DISTINCT p.doc_id, c.implied FROM present p JOIN closure c ON p.term = c.term)
SELECT m.doc_id, m.term, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.weight DESC, h.implied IS NULL, m.term)::INT AS rank FROM missing m LEFT JOIN held h ON h.doc_id = m.doc_id AND h.implied = m.term""",
        "doc_hit", "target", "implies",
    ),
    "q_sections": sql(
        """, s AS (SELECT c.doc_id, CASE WHEN c.line_no > b.edu_at THEN 'education' WHEN c.line_no > b.exp_at THEN 'experience' WHEN c.line_no > b.skills_at THEN 'skills' WHEN c.line_no > b.sum_at THEN 'summary' ELSE 'contact' END AS section
  FROM corpus c JOIN bounds b USING (doc_id) WHERE c.text NOT IN ('Experience', 'MY JOURNEY', 'Education', 'Skills', 'Summary', 'Objective')) SELECT doc_id, section, count(*) AS n FROM s GROUP BY doc_id, section""",
        "corpus", "bounds",
    ),
    "q_entries": sql(
        f""", e AS (SELECT doc_id, entry, min(CASE WHEN is_header THEN line_no END)::INT AS header_line, max(CASE WHEN is_header THEN {extract('raw', P.DATE_RANGE)} END) AS dates, count(CASE WHEN NOT is_header THEN 1 END) AS n_bullets FROM exp_entry WHERE entry > 0 GROUP BY doc_id, entry)
SELECT doc_id, header_line, dates, n_bullets FROM e""",
        "exp_entry",
    ),
    "q_normal_dates": sql(
        f""", e AS (SELECT doc_id, entry, min(CASE WHEN is_header THEN line_no END)::INT AS header_line, max(CASE WHEN is_header THEN {extract('raw', P.DATE_RANGE)} END) AS d FROM exp_entry WHERE entry > 0 GROUP BY doc_id, entry),
p AS (SELECT doc_id, header_line, list_transform(string_split_regex(d, '\\s*–\\s*'), lambda t: CASE WHEN t = 'Present' THEN t WHEN t LIKE '%/%' THEN ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][split_part(t, '/', 1)::INT] || ' ' || split_part(t, '/', 2) ELSE t END) AS t FROM e)
SELECT doc_id, header_line, t[1] || ' – ' || t[2] AS dates FROM p""",
        "exp_entry",
    ),
    "q_years": sql(
        f""", e AS (SELECT doc_id, {extract('raw', P.DATE_RANGE, 1)} AS a, {extract('raw', P.DATE_RANGE, 2)} AS b FROM exp_entry WHERE dated),
y AS (SELECT doc_id, regexp_extract(a, '((?:19|20)\\d{{2}})', 1)::INT AS s, CASE WHEN {matches('b', P.OPEN_END)} THEN 2024 ELSE regexp_extract(b, '((?:19|20)\\d{{2}})', 1)::INT END AS e FROM e)
SELECT doc_id, greatest(0, max(e) - min(s))::INT AS years FROM y GROUP BY doc_id""",
        "exp_entry",
    ),
    "q_date_forms": sql(
        f""", e AS (SELECT doc_id, {extract('raw', P.DATE_RANGE)} AS d FROM exp_entry WHERE dated)
SELECT doc_id, count(DISTINCT CASE WHEN regexp_matches(d, '\\d{{1,2}}/\\d{{2,4}}') THEN 'numeric' WHEN regexp_matches(d, '(?i)[a-z]{{3,}}\\.?\\s*''?\\d{{2,4}}') THEN 'month-year' ELSE 'year' END) AS forms FROM e GROUP BY doc_id HAVING forms > 1""",
        "exp_entry",
    ),
    "q_missing_sections": sql(
        " SELECT doc_id, CASE WHEN edu_at = 1000000 THEN 15 ELSE 0 END + CASE WHEN skills_at IS NULL THEN 15 ELSE 0 END AS cost FROM bounds WHERE edu_at = 1000000 OR skills_at IS NULL", "bounds"
    ),
    "q_contact_missing": sql(
        f""", c AS (SELECT doc_id, coalesce(string_agg(CASE WHEN {matches('text', P.EMAIL)} OR {matches('text', P.PHONE)} OR {matches('text', r'linkedin\.com')} THEN text END, chr(10) ORDER BY line_no), '') AS text FROM corpus GROUP BY doc_id) SELECT doc_id, NOT {matches('text', P.EMAIL)} AS no_email, NOT {matches('text', P.PHONE)} AS no_phone, NOT {matches('text', r'linkedin\.com')} AS no_linkedin,
{matches(f"split_part({extract('text', P.EMAIL)}, '@', 1)", P.EMAIL_TONE)} AS odd_tone FROM c""",
        "corpus",
    ),
    "q_rate_sliding": sql(" SELECT event_id, count(*) OVER (PARTITION BY kind, identity ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM request", "request"),
    "q_rate_tumbling": sql(" SELECT kind, identity, epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS used, count(*) > 2 AS over, CASE WHEN count(*) > 2 THEN date_diff('second', date_trunc('second', max(ts)), time_bucket(INTERVAL 1 HOUR, max(ts), TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR)::INT END AS retry_after FROM request GROUP BY 1, 2, 3", "request"),
    "q_event_dedup": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "q_latest_by_key": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "q_stage_durations": "SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS ended_at FROM conversations",
    "q_quiet_sessions": """WITH o AS (SELECT user_id AS key, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT key, epoch_us(min(ts)) AS started_us, count(*) AS n FROM r GROUP BY key, run""",
    "q_json_props": "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type",
    "q_event_fold": "SELECT user_id AS analysis_id, count(*) AS n_events, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 7 END) AS n_clicks, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done FROM events GROUP BY user_id",
    "q_column_histogram": sql(" SELECT doc_id, page, bin::INT AS bin, count(*) AS n FROM (SELECT doc_id, page, unnest(range(floor(x * 100)::INT, greatest(floor(x * 100)::INT, least(99, ceil((x + w) * 100)::INT)) + 1)) AS bin FROM item WHERE source = 'body') GROUP BY doc_id, page, bin", "item"),
    "q_longest_gap": sql(
        """, hist AS (SELECT doc_id, page, bin, count(*) AS n FROM (SELECT doc_id, page, unnest(range(floor(x * 100)::INT, greatest(floor(x * 100)::INT, least(99, ceil((x + w) * 100)::INT)) + 1)) AS bin FROM item WHERE source = 'body') GROUP BY doc_id, page, bin),
pages AS (SELECT doc_id, page, count(*) AS items FROM item WHERE source = 'body' GROUP BY doc_id, page), bands AS (SELECT doc_id, page, items, unnest(range(20, 81)) AS bin FROM pages),
e AS (SELECT doc_id, page, bin, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS island FROM bands LEFT JOIN hist USING (doc_id, page, bin) WHERE coalesce(n, 0) <= items * 0.05),
r AS (SELECT doc_id, page, min(bin) AS start, count(*) AS width FROM e GROUP BY doc_id, page, island)
SELECT doc_id, page, start::INT AS start, width FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY width DESC, start) AS k FROM r) WHERE k = 1""",
        "item",
    ),
    "q_displaced": sql(
        """, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stream_index) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, stream_index) AS p FROM item WHERE source = 'body')
SELECT doc_id, count(*) AS n, count(CASE WHEN abs(s - p) > 6 THEN 1 END) AS moved, count(*) > 10 AND count(CASE WHEN abs(s - p) > 6 THEN 1 END) > count(*) * 0.25 AS out_of_order FROM r GROUP BY doc_id""",
        "item",
    ),
    "q_running_headers": sql(""", t AS (SELECT DISTINCT doc_id, page, text FROM item WHERE y + h < 0.055) SELECT doc_id, page, text FROM t WHERE (SELECT count(DISTINCT u.page) FROM t u WHERE u.doc_id = t.doc_id AND u.text = t.text) > 1""", "item"),
    "q_table_rows": sql(""" SELECT doc_id, table_id, "row", string_agg(text, ' ' ORDER BY stream_index) AS text FROM item WHERE table_id IS NOT NULL GROUP BY doc_id, table_id, "row" """, "item"),
    "q_upper_median": sql(" SELECT doc_id, list_sort(list(w))[len(list(w)) // 2 + 1] AS median FROM item WHERE w > 0 GROUP BY doc_id", "item"),
    "q_placeholders": sql(
        r""", p AS (SELECT doc_id, line_no, text || CASE WHEN line_no % 2 = 0 THEN ' [[number]]' ELSE '' END || ' [[result: what improved]] [[number]]' AS text FROM work),
u AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(text, '\[\[([^\]]*)\]\]', 1)) AS hints FROM p) SELECT doc_id, line_no, len(hints)::INT AS n FROM u""",
        "work",
    ),
    "q_hunk_runs": """WITH h AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS hunk_ord, CASE WHEN l_partkey % 3 = 0 THEN 'edit' ELSE 'same' END AS kind, CASE WHEN l_linenumber < 4 THEN 'a' ELSE 'b' END AS section FROM lineitem),
n AS (SELECT *, CASE WHEN kind = 'same' AND lag(kind) OVER w = 'same' AND section = lag(section) OVER w THEN 0 ELSE 1 END AS fresh FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY hunk_ord)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY hunk_ord) AS run FROM n) SELECT doc_id, run::INT AS hunk_ord, min(kind) AS kind, min(section) AS section, count(*) AS n FROM r GROUP BY doc_id, run""",
    "q_unreferenced": """SELECT o_custkey AS doc_id, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_custkey""",
    "q_history": """SELECT session_id, doc_id, score FROM (SELECT o_custkey AS session_id, o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice / 1000)::INT END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderpriority <> '1-URGENT') WHERE k <= 30""",
    "q_compare_runs": """WITH a AS (SELECT p_brand AS doc_id, p_type AS category, max(p_size)::INT AS score FROM part GROUP BY 1, 2 HAVING max(p_size) >= 25), b AS (SELECT p_brand AS doc_id, p_type AS category, max(floor(p_retailprice / 100))::INT AS score FROM part GROUP BY 1, 2 HAVING max(floor(p_retailprice / 100)) >= 11)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.category, b.category) AS category, coalesce(a.score, 0) AS before, coalesce(b.score, 0) AS after, coalesce(b.score, 0) - coalesce(a.score, 0) AS delta FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.category = b.category""",
}
