"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed

#: The edges of one node are spread over so many join keys, as a star's centre may have very many.
SALTS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): for each node of some edge the smallest node that it reaches.

    Alternates large-star and small-star steps: every node points its larger neighbours, then
    its smaller ones, to the smallest node it knows, until only stars are left. The number of
    rounds grows with the logarithm of the longest path. Smallest neighbours are aggregated
    before the join, so a node with very many neighbours needs no list of them. Self-loops and
    repeats are allowed; an empty table gives an empty result.
    """
    now = checkpointed(_directed(edges.select("a", "b")))
    while not _only_stars(now):
        now = checkpointed(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def with_root(frame: DataFrame, on: str, roots: DataFrame, spread_by: str) -> DataFrame:
    """frame inner joined with roots (one row for each value of its first column), salted by another column."""
    key = roots.columns[0]
    salted = roots.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = frame.withColumn("__own", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    return own.join(salted, (F.col(on) == F.col(key)) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node either points to one centre or is a centre."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # For each node u and its larger neighbour v: v -> m(u).
    return _directed(with_root(edges, "b", least, "a").select("a", F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    # Each node u and its smaller neighbours -> m(u).
    moved = with_root(edges, "a", least, "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.union(least.select(F.col("u"), F.col("m"))))
