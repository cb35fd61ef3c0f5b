"""A corpus of short career documents derived from the order tables, one document for each customer.

The statement runs unchanged on Spark and on DuckDB, so that queries over it can be compared.
Defects (missing fields, odd headings, weak bullets) are planted by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators.layout import Layout


def _pick(values: list[str], key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {arms} END)"


_FIRST = _pick(["Ada", "Bruno", "Chloe", "Dmitri", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas", "Kira"], "c_custkey")
_LAST = _pick(["Archer", "Bellamy", "Castillo", "Dorsey", "Engel", "Fontaine", "Goddard"], "c_custkey")
_CITY = ["Austin, TX", "Denver, CO", "Portland, OR", "Boston, MA", "Tampa, FL"]
_TITLE = ["Software Engineer", "Data Analyst", "Project Manager", "Account Coordinator", "Nurse", "Warehouse Supervisor"]
_MONTH = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_OPENER = ["Built", "Reduced", "Managed", "Delivered", "Wrote", "Coordinated", "Led", "Automated"]
_WEAK = ["Responsible for", "Helped with", "Worked on", "Assisted in"]
_OBJECT = ["the billing reports", "python import jobs", "the sql warehouse", "customer onboarding", "docker builds", "jenkins pipelines", "a kubernetes cluster", "quarterly budgets", "the crm data", "react dashboards"]
_END = ["cutting turnaround by 12%", "saving 300 hours", "with better coverage", "for the regional team", "across five stores"]

CORPUS_SQL = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, k1, k2, k3, text) AS INT) AS line_no, text FROM (
  SELECT c_custkey AS doc_id, 0 AS block, CAST(0 AS BIGINT) AS k1, 0 AS k2, CAST(0 AS BIGINT) AS k3, concat({_FIRST}, ' ', {_LAST}) AS text FROM customer
  UNION ALL
  SELECT c_custkey, 1, 0, 0, 0, concat_ws(' · ', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(lower({_FIRST}), '.', lower({_LAST}), CASE WHEN c_custkey % 13 = 0 THEN 'cool' ELSE '' END, '@mail.example') END,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('(', CAST(200 + c_custkey % 700 AS VARCHAR(9)), ') 555-', CAST(1000 + c_custkey % 9000 AS VARCHAR(9))) END,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_pick(_CITY, "c_custkey")} END,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('linkedin.com/in/p', CAST(c_custkey AS VARCHAR(9))) END, CASE WHEN c_custkey % 29 = 0 THEN 'open to ﬂexible travel' ELSE 'open to travel' END) FROM customer
  UNION ALL
  SELECT c_custkey, 2, 0, 0, 0, CASE WHEN c_custkey % 9 = 0 THEN 'Objective' ELSE 'Summary' END FROM customer WHERE c_custkey % 6 <> 1
  UNION ALL
  SELECT c_custkey, 3, 0, 0, 0, CASE WHEN c_custkey % 9 = 0 THEN 'Seeking a challenging role where I can grow my skills as a passionate team player in sales.' ELSE 'Results-driven analyst with ten years of work on retail data, reporting and process design.' END FROM customer WHERE c_custkey % 6 <> 1
  UNION ALL
  SELECT c_custkey, 4, 0, 0, 0, 'Skills' FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT c_custkey, 5, 0, 0, 0, CASE WHEN c_custkey % 23 = 0 THEN 'Python, SQL, Docker, Ofﬁce, Excel' WHEN c_custkey % 2 = 0 THEN 'Python, SQL, Docker, Machine Learning, Excel' ELSE 'Java, React, Jenkins, Terraform, C++' END FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT c_custkey, 6, 0, 0, 0, CASE WHEN c_custkey % 6 = 0 THEN 'MY JOURNEY' ELSE 'Experience' END FROM customer
  UNION ALL
  SELECT o_custkey, 7, o_orderkey, 0, 0, concat({_pick(_TITLE, "o_orderkey")}, ' — ', {_pick(["Acme", "Northwind", "Globex", "Initech"], "o_custkey + o_orderkey")}, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 4 = 0
    THEN concat(' | ', CAST(month(o_orderdate) AS VARCHAR(9)), '/', CAST(year(o_orderdate) AS VARCHAR(9)), ' – ', CAST(month(o_orderdate) AS VARCHAR(9)), '/', CAST(year(o_orderdate) + 1 AS VARCHAR(9)))
    ELSE concat(', ', {_pick(_CITY, "o_orderkey")}, ' | ', {_pick(_MONTH, "month(o_orderdate) - 1")}, ' ', CAST(year(o_orderdate) AS VARCHAR(9)), ' – ', CASE WHEN o_orderkey % 11 = 0 THEN 'Present' ELSE concat('Jun ', CAST(year(o_orderdate) + 1 + o_orderkey % 3 AS VARCHAR(9))) END) END) FROM orders
  UNION ALL
  SELECT o_custkey, 7, o_orderkey, l_linenumber, l_partkey, concat(CASE WHEN l_orderkey % 97 = 0 THEN '➢ ' ELSE '• ' END, CASE WHEN l_linenumber % 3 = 0 THEN {_pick(_WEAK, "l_partkey")} ELSE {_pick(_OPENER, "l_suppkey + l_linenumber")} END, ' ', {_pick(_OBJECT, "l_partkey")},
    CASE WHEN l_partkey % 5 = 0 THEN ' and various other tasks' ELSE '' END, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE concat(' in ', CAST(2 + l_partkey % 40 AS VARCHAR(9)), ' regions') END,
    CASE WHEN l_suppkey % 3 = 0 THEN concat(', ', {_pick(_END, "l_suppkey")}) ELSE '' END, '.') FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT c_custkey, 8, 0, 0, 0, 'Education' FROM customer WHERE c_custkey % 8 <> 0
  UNION ALL
  SELECT c_custkey, 9, 0, 0, 0, 'B.S. Economics, State University, 2008' FROM customer WHERE c_custkey % 8 <> 0
  UNION ALL
  SELECT c_custkey, 10, 0, 0, 0, 'References available upon request' FROM customer WHERE c_custkey % 17 = 0
) AS blocks
"""


#: What the documents' files look like on the page: positioned items, images and files.
LAYOUT_SQL = {
    "items": """
SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 3 THEN 5000 - r ELSE r END + 10 AS INT) AS stream_index, text, CAST(1 + floor(r / 60.0) AS INT) AS page,
  CAST(CASE WHEN doc_id % 4 = 0 AND r % 2 = 1 THEN 0.58 ELSE 0.06 END AS DOUBLE) AS x, CAST(CASE WHEN doc_id % 4 = 0 THEN 0.08 + floor((r % 60) / 2.0) * 0.028 ELSE 0.08 + (r % 60) * 0.014 END AS DOUBLE) AS y,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 0.34 ELSE 0.8 END AS DOUBLE) AS w, CAST(0.012 AS DOUBLE) AS h, 'body' AS source, CAST(NULL AS VARCHAR(9)) AS table_id, CAST(NULL AS INT) AS row_no, CAST(NULL AS INT) AS col FROM (
  SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r, concat('part ', CAST(l_partkey AS VARCHAR(9)), ' shipped') AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS body
UNION ALL SELECT c_custkey, 0, CASE WHEN c_custkey % 14 = 0 THEN 'desk@mail.example' ELSE 'Curriculum vitae' END, 1, CAST(0.06 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.012 AS DOUBLE), 'header', NULL, NULL, NULL FROM customer WHERE c_custkey % 14 = 0 OR c_custkey % 5 = 1
UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 10 = 5 THEN '(212) 555-0199' ELSE 'Page 1 of 2' END, 1, CAST(0.06 AS DOUBLE), CAST(0.96 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.012 AS DOUBLE), 'footer', NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 5 OR c_custkey % 6 = 0
UNION ALL SELECT c_custkey, 2 + k, concat('box ', CAST(k AS VARCHAR(9))), 1, CAST(0.7 AS DOUBLE), CAST(0.3 + k * 0.1 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.012 AS DOUBLE), 'textbox', NULL, NULL, NULL FROM customer, (VALUES (0), (1)) AS n(k) WHERE c_custkey % 8 = 3
UNION ALL SELECT c_custkey, CAST(6000 + k AS INT), concat('cell ', CAST(k AS VARCHAR(9))), 1, CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.012 AS DOUBLE), 'table', concat('T', CAST(CAST(floor(k / 4.0) AS INT) AS VARCHAR(9))), CAST(floor((k % 4) / 2.0) AS INT), CAST(k % 2 AS INT)
  FROM customer, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS n(k) WHERE c_custkey % 27 = 4 OR (c_custkey % 9 IN (2, 4) AND k < 4)
""",
    "images": "SELECT c_custkey AS doc_id, CAST(1 + k AS INT) AS page, CASE WHEN c_custkey % 11 = 1 THEN '14 vector shapes' ELSE 'photo' END AS description FROM customer, (VALUES (0), (1), (2), (3)) AS n(k) WHERE c_custkey % 33 = 2 OR (c_custkey % 11 < 3 AND k = 0)",
    "files": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 27 IN (4, 11) THEN 'docx' ELSE 'pdf' END AS file_type, CASE WHEN c_custkey % 16 = 0 THEN 3000000 ELSE 100000 END AS file_size, CASE WHEN c_custkey % 21 = 0 THEN 2 ELSE 1 END AS declared_columns FROM customer",
}

#: Short documents, one for each customer, for the rules that the corpus above never breaks; every order is an entry with three bullets.
PLANTED_SQL = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, k1, k2) AS INT) AS line_no, text FROM (
  SELECT c_custkey AS doc_id, 0 AS block, CAST(0 AS BIGINT) AS k1, 0 AS k2, CASE WHEN c_custkey % 5 = 0 THEN 'application papers' ELSE concat({_FIRST}, ' ', {_LAST}) END AS text FROM customer
  UNION ALL SELECT c_custkey, 1, 0, 0, concat('p', CAST(c_custkey AS VARCHAR(9)), '@mail.example', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' · (212) 555-0142 · Austin, TX · linkedin.com/in/p1' END) FROM customer
  UNION ALL SELECT c_custkey, 1, 0, n.k, n.said FROM customer JOIN (VALUES (1, '(212) 555-0142'), (2, 'Austin, TX'), (3, 'linkedin.com/in/p1'), (4, 'github.com/p1')) AS n(k, said) ON c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, 2, 0, 0, 'Summary' FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey, 3, 0, 0, 'Analyst of retail data with long practice in reports and process design.' FROM customer
  UNION ALL SELECT c_custkey, 3, 0, 1, concat(repeat('careful work on plans and budgets, ', CASE WHEN c_custkey % 7 = 0 THEN 14 ELSE 12 END), 'every week.') FROM customer WHERE c_custkey % 7 < 2
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN 4 ELSE 8 END, 0, 0, 'Education' FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN 4 ELSE 8 END, 0, 1, concat('B.S. in Economics and Statistics, State University', CASE WHEN c_custkey % 8 = 0 THEN '' ELSE ', 2008' END) FROM customer
  UNION ALL SELECT c_custkey, 5, 0, 0, 'Skills' FROM customer
  UNION ALL SELECT c_custkey, 5, 0, 1, 'Python, SQL, Docker, Excel, Tableau' FROM customer
  UNION ALL SELECT c_custkey, 6, 0, 0, CASE WHEN c_custkey % 6 = 0 THEN 'MY JOURNEY' ELSE 'Experience' END FROM customer
  UNION ALL SELECT o_custkey, 7, o_orderkey, 0, concat({_pick(["Software Engineer", "Nurse", "Project Manager"], "o_custkey")}, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(' — ', {_pick(["Acme", "Northwind", "Globex"], "o_orderkey")}) END,
    ' | ', {_pick(_MONTH, "month(o_orderdate) - 1")}, ' ', CAST(year(o_orderdate) AS VARCHAR(9)), ' – Jun ', CAST(year(o_orderdate) + 1 + o_orderkey % 3 AS VARCHAR(9))) FROM orders
  UNION ALL SELECT o_custkey, 7, o_orderkey, n.k, concat('• ', CASE WHEN o_custkey % 9 = 0 OR (o_custkey % 9 = 1 AND n.k < 3) THEN 'Improved the billing reports by 12%, resulting in faster work'
    WHEN n.k = 1 THEN 'Built the sql warehouse for five stores' WHEN n.k = 2 THEN 'Reduced the cost of docker builds by 12%' ELSE 'Wrote the quarterly budgets for the regional team' END,
    CASE WHEN n.k = 2 AND o_orderkey % 13 < 2 THEN repeat(' and kept careful notes', CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 6 END) ELSE '' END, '.') FROM orders JOIN (VALUES (1), (2), (3)) AS n(k) ON n.k > 0
) AS blocks
"""

#: Events of the table as an analysis' events in JSON, some of them broken by their numbers; runs on both engines.
EVENT_JSON = """CASE event_id % 8 WHEN 0 THEN concat('{"type":"stage","stage":"', CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'parse' END, '","at":', CAST(event_id AS VARCHAR(20)), '}')
WHEN 1 THEN concat('{"type":"finding","finding":{"id":"f', CAST(event_id AS VARCHAR(20)), '","severity":', CASE WHEN event_id % 3 = 0 THEN '2' ELSE '"low"' END, '}}')
WHEN 2 THEN concat('{"type":"aggregate","overallScore":', CASE WHEN event_id % 3 = 1 THEN 'null' ELSE CAST(event_id % 100 AS VARCHAR(20)) END, ',"keywordMap":[]}')
WHEN 3 THEN '{"type":"done","at":1.5,"aiUsed":"no"}' WHEN 4 THEN '{"type":"finding"}' WHEN 5 THEN '{"kind":"done"}' WHEN 6 THEN '{"type":"done","at":' ELSE '{"type":"done","at":7}' END"""


def derived_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """The layout of the derived documents."""
    tables = _tables(spark, sf_dir)
    items, images, files = (spark.sql(_spark_form(sql), **tables) for sql in LAYOUT_SQL.values())
    return Layout(items.withColumnRenamed("row_no", "row"), images, files)


def derived_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text)."""
    return spark.sql(_spark_form(CORPUS_SQL), **_tables(spark, sf_dir))


def planted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text) of the documents that break the rules which the derived corpus keeps."""
    return spark.sql(_spark_form(PLANTED_SQL), **_tables(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "orders", "lineitem")}


def _spark_form(sql: str) -> str:
    """Table names become parameters of spark.sql, so that no view is registered in the session."""
    for name in ("customer", "orders", "lineitem"):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return sql
