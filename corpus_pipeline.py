"""Preparing the documents table for training, in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import meet, row_hash, table, written
from vellum.llm.decontaminate import decontaminate
from vellum.llm.language import UNKNOWN, identify_languages
from vellum.llm.mixing import mixed_documents
from vellum.llm.secrets import redact, scan_secrets
from vellum.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if every language's regression output is under -0.5 (of -1 to 1); mixed and very short clean texts stay well above.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter, that hold too few n-grams of the learned languages, or that no language claims.

    A null or empty text has no letter and goes; a null id, lang or source doesn't matter. Each of
    repeated rows is judged like the others. Without any labelled row, and in an empty table, none is kept.
    """
    found = identify_languages(docs, keep=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE) & F.col("known")).select(*COLUMNS)


def _key(row: Column) -> Column:
    return F.struct(*[F.xxhash64(F.lit(lane), row).alias(f"h{lane}") for lane in (1, 2)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group.

    A row is told by its id and text, for ids may be null or repeated; null ids come last. Rows that
    repeat both are one document, of which the one with the least other columns stays. Texts are
    shuffled for such rows alone; what goes is told by a broadcast, up to a checked number.
    """
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row_hash(F.col("text")).alias("text")).alias("__row"))
    rows = rows.withColumn("__key", _key(F.col("__row")))
    groups = near_duplicates(rows, id_col="__row")
    dropped = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    marks = written(groups.select(_key(F.col("doc_id")).alias("__key"), dropped.alias("drop")).groupBy("__key").agg(F.max("drop").alias("__drop"), F.count("*").alias("n")).filter("__drop or n > 1").drop("n"))
    marked = meet(rows, marks, "__key")
    once = marked.filter("__drop is null").select(*COLUMNS)
    repeated = marked.filter("not __drop").groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.union(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item of five words or more; each row goes by its own text. Null and empty texts stay; no item, or no document, changes nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets; every row stays, repeated ones too. A null text becomes empty."""
    found = scan_secrets(docs, keep=["lang", "source"]).withColumn("text", redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target; copy_no is added. A null source is one of its own; every row is drawn for on its own."""
    return mixed_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
#: SQL cannot express the language and SimHash stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written to the shared folder, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
