"""The term dictionary: terms with aliases, a category and the terms they imply.

The default is a small one of our own; a larger one is a table with the same columns, read
from a path of the caller's and passed on as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ord int, term string, category string, aliases array<string>, implies array<string>"
#: term; category; aliases; implied terms.
DEFAULT = (
    ("python", "language", (), ("programming",)),
    ("java", "language", (), ("programming",)),
    ("c++", "language", ("cpp",), ("programming",)),
    ("c", "language", (), ("programming",)),
    ("r", "language", (), ("statistics",)),
    ("go", "language", ("golang",), ("programming",)),
    ("programming", "skill", ("coding",), ()),
    ("sql", "data", (), ("databases",)),
    ("databases", "data", ("database",), ()),
    ("data warehouse", "data", ("sql warehouse",), ("sql",)),
    ("machine learning", "data", ("ml",), ("statistics",)),
    ("statistics", "data", ("statistical analysis",), ()),
    ("excel", "office", ("spreadsheets",), ()),
    ("docker", "infrastructure", ("containers",), ("containerization",)),
    ("kubernetes", "infrastructure", ("k8s",), ("docker",)),
    ("containerization", "infrastructure", (), ()),
    ("jenkins", "infrastructure", (), ("ci/cd",)),
    ("ci/cd", "infrastructure", ("continuous integration", "ci"), ("devops",)),
    ("devops", "infrastructure", (), ()),
    ("terraform", "infrastructure", (), ("infrastructure as code",)),
    ("infrastructure as code", "infrastructure", ("iac",), ("devops",)),
    ("react", "web", ("react.js",), ("frontend",)),
    ("node.js", "web", ("node",), ("javascript",)),
    ("javascript", "web", ("js",), ("frontend",)),
    ("frontend", "web", ("front end",), ()),
    ("crm", "business", (), ()),
    ("budgeting", "business", ("budgets",), ()),
    ("customer onboarding", "business", ("onboarding",), ("customer success",)),
    ("customer success", "business", (), ()),
    ("reporting", "business", ("reports",), ()),
    ("process improvement", "business", (), ()),
    ("communication", "soft", (), ()),
)
#: A target list for role queries: term and weight.
DEFAULT_TARGETS = (
    ("python", 3), ("sql", 3), ("docker", 2), ("ci/cd", 2), ("devops", 2), ("containerization", 1), ("machine learning", 2), ("statistics", 1),
    ("reporting", 1), ("c++", 1), ("r", 1), ("infrastructure as code", 2), ("communication", 1),
)
#: Role presets: titles that name the role, and its terms with weights.
ROLES = {
    "software-engineer": (("software engineer", "developer"), (("python", 2), ("java", 2), ("docker", 1), ("ci/cd", 1))),
    "data-analyst": (("data analyst", "analyst"), (("sql", 3), ("excel", 2), ("reporting", 1))),
    "project-manager": (("project manager",), (("budgeting", 2), ("communication", 1))),
    "nurse": (("nurse", "registered nurse"), (("communication", 2),)),
    "general": ((), ()),
}


def default_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, c, list(a), list(m)) for i, (t, c, a, m) in enumerate(DEFAULT)], SCHEMA)


def default_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_TARGETS), "term string, weight int")

#: The key of the example tokens.
TOKEN_KEY = b"an example key that is not a secret"
