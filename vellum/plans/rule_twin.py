"""The SQL twin of the rules that only the planted documents break; sections, entries and contact lines are told from the text."""

from __future__ import annotations

from vellum.functions import patterns as P
from vellum.operators.findings import RULES, TECH_ROLES
from vellum.operators.lines import NAME
from vellum.plans.corpus import PLANTED_SQL
from vellum.plans.oracle import _SHAPE, _STRIP, _words, extract, lit, matches
from vellum.plans.terms import DEFAULT, ROLES

#: The rules that the twin knows.
PLANTED = (
    "nonstandard-heading", "unlabeled-summary", "undated-entry", "incomplete-entry", "section-order", "identical-structure", "overlong", "summary-long", "missing-name", "missing-portfolio", "contact-sprawl",
)


def _any_of(values: tuple[str, ...]) -> str:
    return f"({', '.join(map(lit, values))})"


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[_:|•·\-–—]+$', ''), '[^a-z&\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMED = "CASE WHEN is_bullet OR words > 5 THEN NULL " + " ".join(f"WHEN norm IN {_any_of(names)} THEN {lit(section)}" for section, names in P.HEADINGS.items()) + " END"
_HINT = "CASE " + " ".join(f"WHEN {matches('lower(text)', p)} THEN {lit(section)}" for section, p in P.HEADING_HINTS) + " ELSE 'other' END"
_DIGITS = matches("text", r"\d{4}")
_BARE = f"regexp_replace(text, {lit(P.EMAIL)}, '', 'g')"
_CONTACT = (
    f"NOT is_bullet AND ({matches('text', P.EMAIL)} OR {matches('text', P.PHONE)} OR {matches(_BARE, P.URL)} "
    f"OR (NOT {_DIGITS} AND (({matches('text', P.STRICT_LOCATION)} AND words <= 6) OR (line_no <= 8 AND {matches('text', P.LOCATION)} AND words <= 4))))"
)
_ENTRY = _any_of(P.ENTRY_SECTIONS)
_REST = f"regexp_replace(replace(text, {extract('text', P.DATE_RANGE)}, ''), {lit(P.STRICT_LOCATION)}, ' ', 'g')"
_YEAR = "((?:19|20)\\d{2})"


def _points(role: str) -> str:
    words, terms = ROLES[role]
    own = [f"{(6 if role == 'software-engineer' else 10) if len(w) > 4 else 4} * regexp_matches(titles, '(^|[^a-z]){w}([^a-z]|$)')::INT" for w in words]
    forms = {t: (t, *aliases) for t, _, aliases, _ in DEFAULT}
    held = [f"{n} * (" + " OR ".join(f"regexp_matches(said, '(^|[^a-z0-9]){f}([^a-z0-9+#]|$)')" for f in forms[t]) + ")::INT" for t, n in terms]
    return " + ".join([*own, *held])


_ROLES = [r for r in ROLES if ROLES[r][0]]
_BEST = f"greatest({', '.join(_points(r) for r in _ROLES)})"
_ROLE = f"CASE WHEN {_BEST} < 8 THEN 'general' " + " ".join(f"WHEN {_points(r)} = {_BEST} THEN {lit(r)}" for r in _ROLES) + " END"


def _finding(rule: str, found: str) -> str:
    """The findings of a rule from (doc_id, line_no) rows, in order of lines until the rule's cap."""
    _, cost, cap, _ = RULES[rule]
    least = cost if cap is None else f"least({cost}, {cap} - {cost} * (k - 1))"
    kept = "" if cap is None else f" WHERE {cost} * (k - 1) < {cap}"
    return f"SELECT doc_id, {lit(rule)} AS rule_id, line_no, ({least})::DOUBLE AS cost FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ({found})){kept}"


_FOUND = {
    "nonstandard-heading": "SELECT doc_id, line_no FROM s WHERE odd AND opens IS NOT NULL",
    "unlabeled-summary": "SELECT doc_id, min(line_no) AS line_no FROM s WHERE section_no = 0 AND section = 'summary' GROUP BY doc_id",
    "undated-entry": f"SELECT doc_id, line_no FROM s WHERE opens IS NULL AND section = 'education' AND {matches('text', P.DEGREE)} AND NOT {matches('text', P.SINGLE_DATE)}",
    "incomplete-entry": f"SELECT doc_id, line_no FROM head WHERE len(list_filter(regexp_split_to_array({_REST}, '\\s*(?:\\||—|–|,\\s)\\s*') , lambda x: length(trim(x)) > 1)) < 2",
    "section-order": f"""SELECT doc_id, line_no FROM (SELECT doc_id, min(CASE WHEN opens IS NULL AND section = 'education' THEN line_no END) AS edu_at, min(CASE WHEN opens IS NULL AND section = 'experience' THEN line_no END) AS exp_at, min(CASE WHEN opens = 'education' THEN line_no END) AS line_no FROM s GROUP BY doc_id)
    JOIN (SELECT doc_id, max(regexp_extract({extract('text', P.DATE_RANGE, 2)}, '{_YEAR}', 1)::INT) - min(regexp_extract({extract('text', P.DATE_RANGE, 1)}, '{_YEAR}', 1)::INT) AS years FROM head GROUP BY doc_id) USING (doc_id) WHERE edu_at < exp_at AND years >= 3""",
    "identical-structure": """SELECT doc_id, line_no FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_no) AS k FROM (SELECT doc_id, shape, count(*) AS n, min(line_no) AS line_no FROM work GROUP BY doc_id, shape))
    WHERE k = 1 AND total >= 5 AND n >= 0.7 * total AND length(replace(shape, 'x', '')) >= 2""",
    "overlong": "SELECT doc_id, line_no FROM work WHERE words > 40",
    "summary-long": "SELECT doc_id, min(line_no) AS line_no FROM s WHERE opens IS NULL AND section = 'summary' GROUP BY doc_id HAVING sum(words) > 90",
    "missing-name": "SELECT doc_id, 1 AS line_no FROM s GROUP BY doc_id HAVING NOT bool_or(named_person)",
    "missing-portfolio": f"""SELECT doc_id, 1 AS line_no FROM (SELECT doc_id, lower(string_agg(CASE WHEN section = 'experience' AND NOT is_bullet AND opens IS NULL THEN text END, ' | ')) AS titles, lower(string_agg(CASE WHEN section IN ('skills', 'summary') AND opens IS NULL THEN text END, ' | ')) AS said,
    bool_or(len(list_filter(regexp_extract_all({_BARE}, {lit(P.URL)}), lambda x: NOT regexp_matches(x, '(?i)linkedin[.]com'))) > 0) AS shown FROM s GROUP BY doc_id) WHERE NOT shown AND titles IS NOT NULL AND {_ROLE} IN {_any_of(TECH_ROLES)}""",
    "contact-sprawl": "SELECT doc_id, min(line_no) AS line_no FROM s WHERE contact AND section = 'contact' GROUP BY doc_id HAVING count(*) > 4",
}

SQL = {
    "q_planted_rules": f"""WITH c AS ({PLANTED_SQL}),
b AS (SELECT doc_id, line_no, {_STRIP.format('text')} AS text, {matches('text', '^[•➢] ')} AS is_bullet FROM c),
w AS (SELECT *, {_words('text')} AS words, {_NORM} AS norm FROM b),
m AS (SELECT *, {_CONTACT} AS contact, line_no = 1 AND words BETWEEN 2 AND 4 AND {matches('text', NAME)} AS named_person, {_NAMED} AS named FROM w),
p AS (SELECT *, named IS NULL AND NOT is_bullet AND NOT contact AND text = upper(text) AND regexp_matches(text, '[A-Z]') AND words BETWEEN 2 AND 5 AND length(text) < 40 AND NOT {_DIGITS} AS odd, last_value(named IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM m),
o AS (SELECT *, coalesce(named, CASE WHEN odd AND part IS NOT NULL AND part NOT IN {_ENTRY} THEN {_HINT} END) AS opens FROM p),
t AS (SELECT *, count(opens) OVER v AS section_no, last_value(opens IGNORE NULLS) OVER v AS told FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY line_no)),
l AS (SELECT *, bool_or(section_no = 0 AND words > 6 AND NOT contact AND NOT named_person) OVER (PARTITION BY doc_id ORDER BY line_no) AS late FROM t),
s AS (SELECT *, CASE WHEN section_no > 0 THEN told WHEN late AND NOT contact AND NOT named_person THEN 'summary' ELSE 'contact' END AS section FROM l),
head AS (SELECT doc_id, line_no, text FROM s WHERE section = 'experience' AND opens IS NULL AND NOT is_bullet AND {matches('text', P.DATE_RANGE)}),
work AS (SELECT doc_id, line_no, words, {_SHAPE} AS shape FROM s WHERE section = 'experience' AND is_bullet)
""" + "\nUNION ALL ".join(_finding(rule, _FOUND[rule]) for rule in PLANTED),
}
