"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights; a term is a component. Candidates and queries
are dealt into blocks of bounded size, and every pair of blocks is one group: the weighted
postings of each term are scattered into dense score arrays of a few queries at a time,
partition selection keeps each query's best of the block, and the blocks' bests are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a block on average, and queries whose scores are accumulated together.
CANDIDATE_BLOCK, QUERY_BLOCK, TILE = 8192, 1024, 16
LONG = (-(2**63) + 1, 2**63 - 1)


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) for each component, x as double; null for vectors that are null or hold a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fit = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(doubles, lambda x: F.floor(x * F.lit(scale))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the weights; what a shorter row lacks weighs 0."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def block_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score, own) of each query's k best rows of the block, ties to the smaller id; own: of the query's id and weights."""
    order = np.argsort(ids, kind="stable")
    ids, weights, n = ids[order], weights[order], len(ids)
    reach = lambda x: max(abs(int(x.min(initial=0))), int(x.max(initial=0)))
    most = reach(queries) * reach(weights) * max(1, weights.shape[1])
    # Sums are exact in a type whose integers reach the largest possible one.
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    postings = []
    for term in range(weights.shape[1]):
        held = np.flatnonzero(weights[:, term])
        dense = 2 * len(held) >= n
        postings.append((None if dense else held, weights[:, term].astype(kind) if dense else weights[held, term].astype(kind)))
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(query_ids), TILE):
        part = queries[a : a + TILE].astype(kind)
        scores, scratch = np.zeros((len(part), n), dtype=kind), np.empty((len(part), n), dtype=kind)
        for term, (held, value) in enumerate(postings):
            if not part[:, term].any() or not len(value):
                continue
            if held is None:
                np.multiply(part[:, term, None], value, out=scratch)
                scores += scratch
            else:
                scores[:, held] += part[:, term, None] * value
        # One key orders by score, then by smaller id.
        whole = (scores if kind is not object else np.clip(scores, *LONG)).astype(np.int64)
        if most < 2**62 // max(n, 1) // 2:
            keys = whole * n + (n - 1 - np.arange(n))
            best = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), keys.shape)
        else:
            best = np.stack([np.lexsort((np.arange(n), -row))[:k] for row in whole]) if n else np.zeros((len(part), 0), int)
        line = np.repeat(np.arange(len(part)), best.shape[1])
        best = best.ravel()
        own = (ids[best] == query_ids[a + line]) & (weights[best] == queries[a + line]).all(axis=1)
        found.append((a + line, ids[best], whole[line, best], own))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (ids[:0], ids[:0], ids[:0], ids[:0] > 0)


def exact_topk(queries: DataFrame, candidates: DataFrame, *, k: int = 20, id_col: str = "vec_id", weights_col: str = "weights") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest inner product, all if fewer.

    Every row is a query, or a candidate, of its own, rows that repeat an id too. A query's own
    row is no candidate of its: of the candidates with its id and weights one is left out, whichever, as they are
    alike. Ties go to the smaller id. Rows whose id or weights are null take no part. A score beyond 64 bits
    counts as the last one within. Empty tables give an empty result; other columns are not read.
    """

    def own(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(id_col).cast("long").alias("id"), F.col(weights_col).cast("array<long>").alias("weights")).dropna()

    # Equal queries are searched once and returned as often as they are asked.
    asked, held = own(queries).groupBy("id", "weights").agg(F.count("*").alias("times")), own(candidates)
    blocks = lambda frame, size: max(1, -(-frame.count() // size))
    n_asked, n_held = blocks(asked, QUERY_BLOCK), blocks(held, CANDIDATE_BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *by: F.pmod(F.xxhash64("id", "weights", *by), F.lit(n)).cast("int")
    # Rows that repeat an id, or an id and its weights, are spread like any others.
    left = held.withColumn("c", block(n_held, F.spark_partition_id())).withColumn("q", numbers(n_asked))
    right = asked.withColumn("q", block(n_asked)).withColumn("c", numbers(n_held))

    def best(some: pa.Table, asking: pa.Table) -> pa.Table:
        width = max([0, *(int(t["weights"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (some, asking) if t.num_rows)])
        if not some.num_rows or not asking.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(),) * 5 + (pa.bool_(),)], names=names)
        # One more than asked for, as the query's own row may be among them.
        at, ids, scores, own_row = block_best(asking["id"].to_numpy(), _matrix(asking["weights"], width), some["id"].to_numpy(), _matrix(some["weights"], width), k + 1)
        of = asking.select(["id", "key", "times"]).take(pa.array(at))
        return pa.table([*of.columns, pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(own_row, pa.bool_())], names=names)

    names = ["query_id", "key", "times", "vec_id", "score", "own"]
    right = right.withColumn("key", F.xxhash64("weights"))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(best, "query_id long, key long, times long, vec_id long, score long, own boolean")
    one = Window.partitionBy("query_id", "key")
    placed = found.withColumn("place", F.row_number().over(one.orderBy(F.desc("score"), "vec_id", F.desc("own")))).filter(F.col("place") <= k + 1)
    own_place = F.coalesce(F.min(F.when(F.col("own"), F.col("place"))).over(one), F.lit(k + 1))
    ranked = placed.withColumn("own_place", own_place).filter("place != own_place").withColumn("rank", F.col("place") - (F.col("place") > F.col("own_place")).cast("int"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", again.alias("time")).drop("time")
