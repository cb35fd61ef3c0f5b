"""Stored runs: tables with expiry, histories and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that records are kept; fixed values.
KEEP_DAYS = {"anonymous": 7, "saved": 365, "share": 30}


def append_records(records: DataFrame, path: str, kind: str) -> None:
    """Appends records with their expiry to a table that is partitioned by kind."""
    expires = F.current_timestamp() + F.make_dt_interval(F.lit(KEEP_DAYS[kind]))
    records.withColumn("kind", F.lit(kind)).withColumn("expires_at", expires).write.mode("append").partitionBy("kind").parquet(path)


def put(records: DataFrame, path: str, kind: str, key: str = "id") -> None:
    """Upserts records by key: appended with the time they were written; `current` reads the last of each key."""
    append_records(records.withColumns({"key": F.col(key).cast("string"), "written_at": F.current_timestamp()}), path, kind)


def current(records: DataFrame, now: Column | None = None) -> DataFrame:
    """The last record of each kind and key that hasn't expired; a record that replaced another hides it even when it has expired itself."""
    others = [c for c in records.columns if c not in ("kind", "key")]
    last = records.groupBy("kind", "key").agg(F.max_by(F.struct(*others), F.struct("written_at", "expires_at")).alias("r")).select("kind", "key", "r.*")
    return live(last, now)


def ranged(entries: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, seq, value): each list's entries from start to stop, both included, newest first; entries are pushed by appending rows with a higher seq."""
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    return entries.withColumn("place", F.row_number().over(newest) - 1).filter(F.col("place").between(start, stop))


def counters(hits: DataFrame, seconds: int) -> DataFrame:
    """(key, bucket, n): hits (key, ts) in each span of so many seconds since the epoch; runs on a stream with a watermark."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds).cast("long")
    return hits.groupBy("key", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def share_tokens(ids: DataFrame, secret: str, now: Column | None = None) -> DataFrame:
    """(token, id, expires_at): a token of 24 hex digits for each id, which only the holder of the secret can make."""
    token = F.left(F.sha2(F.concat_ws(":", F.lit(secret), F.col("id").cast("string")), 256), F.lit(24))
    at = F.current_timestamp() if now is None else now
    return ids.select(token.alias("token"), "id", (at + F.make_dt_interval(F.lit(KEEP_DAYS["share"]))).alias("expires_at"))


def resolve_tokens(asked: DataFrame, shares: DataFrame, now: Column | None = None) -> DataFrame:
    """(token, id): asked tokens with the id they stand for; null for unknown and expired ones."""
    return asked.join(live(shares, now).select("token", "id"), "token", "left")


def reown(records: DataFrame, owners: DataFrame) -> DataFrame:
    """records (session_id, owner_uid, expires_at, ...) of the sessions in owners (session_id, uid) pass to the user and no longer expire as anonymous ones do."""
    kept = F.current_timestamp() + F.make_dt_interval(F.lit(KEEP_DAYS["saved"]))
    joined = records.join(owners.select("session_id", F.col("uid").alias("__uid")), "session_id", "left")
    taken = F.col("__uid").isNotNull()
    return joined.withColumns({"owner_uid": F.coalesce("__uid", "owner_uid"), "expires_at": F.when(taken, F.greatest("expires_at", kept)).otherwise(F.col("expires_at"))}).drop("__uid").select(*records.columns)


def overlay(rows: DataFrame, patches: DataFrame, on: list[str]) -> DataFrame:
    """rows with the values of patches, where they have one, in place of their own."""
    named = patches.select(*on, *[F.col(c).alias(f"__{c}") for c in patches.columns if c not in on])
    patched = {c for c in patches.columns if c not in on}
    return rows.join(named, on, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in patched else F.col(c) for c in rows.columns])


def live(records: DataFrame, now: Column | None = None) -> DataFrame:
    return records.filter(F.col("expires_at") > (F.current_timestamp() if now is None else now))


def history(ids: DataFrame, docs: DataFrame, analyses: DataFrame, most: int = 30) -> DataFrame:
    """(session_id, seq, doc_id, score): a session's newest documents with their analysis, if any; ids without a document are dropped."""
    joined = ids.join(docs, "doc_id").join(analyses, "doc_id", "left")
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return joined.withColumn("__at", F.row_number().over(newest)).filter(F.col("__at") <= most).select("session_id", "seq", "doc_id", "score")


def not_in_history(own: DataFrame, listed: DataFrame) -> DataFrame:
    return listed.unionByName(own.join(listed, "doc_id", "left_anti"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, category, before, after, delta): scores of two runs by category, 0 where one lacks it."""
    joined = before.select("doc_id", "category", F.col("score").alias("before")).join(after.select("doc_id", "category", F.col("score").alias("after")), ["doc_id", "category"], "full")
    filled = joined.fillna(0, ["before", "after"])
    return filled.withColumn("delta", F.col("after") - F.col("before"))


def line_marks(findings: DataFrame) -> DataFrame:
    """(doc_id, line_no, rank, n, categories): the worst severity, the number and the categories of each line's findings; missing keywords aside."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    own = findings.filter("rule_id <> 'missing-keyword'")
    return own.groupBy("doc_id", "line_no").agg(F.max(rank).alias("rank"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
