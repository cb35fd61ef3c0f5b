"""Whitening of embeddings by their principal components.

Components c of a vector become integers x = floor(scale * c). Exact integer sums over the distinct
x-vectors give the mean; a second pass sums outer products of the centred vectors, a matrix product
a batch; treeAggregate merges one matrix a partition, LAPACK decomposes the sum, and every row is
projected by what is shipped with the task. A third pass measures the covariance of the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import written

#: Dimensions at most: a partial sum holds their square as doubles (128 MB).
MAX_DIMENSIONS = 4096
#: Numbers of a batch that are centred and multiplied at once.
BATCH_NUMBERS = 1 << 20
_LONG = 1 << 63


def scaled(embedding: str, scale: int) -> Column:
    """floor(scale * c) of each component, as longs; null if the vector is null, holds a null or a non-finite component, or one whose result is no long."""
    c = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    usable = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * F.lit(float(scale))) < F.lit(float(_LONG))))
    return F.when(usable, F.transform(c, lambda v: v.cast("long")))


def _rows(column: pa.Array, dimensions: int) -> Iterator[np.ndarray]:
    """A column of long arrays of one length as matrices of BATCH_NUMBERS numbers at most."""
    step = max(1, BATCH_NUMBERS // max(1, dimensions))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dimensions)


def _exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers: high and low halves are summed apart, so nothing overflows."""
    high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low)]


def _merged(frame: DataFrame, each: Callable[[Iterator[np.ndarray]], object], dimensions: int, zero: object, add: Callable) -> object:
    """each() of the matrices of every partition, merged by add in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(m for b in batches for m in _rows(b.column(0), dimensions))
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(found)], pa.binary())})

    parts = frame.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeAggregate(zero, add, add, depth=2)


@dataclass
class Whitening:
    """n distinct vectors with sums S; weights: dimensions x components, unit eigenvectors over the root of their eigenvalues, null columns where nothing varies."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def apart(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs if they fit, else Python integers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))))
        if most < _LONG:
            return rows * self.n - np.array(self.sums, dtype=np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return self.apart(rows).astype(np.float64) / self.n

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The squared length of n * x - S; null if it is no long."""
        d = self.apart(rows)
        if d.dtype != object and (int(np.abs(d).max(initial=0)) ** 2) * max(1, d.shape[1]) < _LONG:
            return (d * d).sum(axis=1).tolist()
        squares = [sum(int(v) ** 2 for v in row) for row in d]
        return [s if s < _LONG else None for s in squares]


def _moments(model: Whitening) -> Callable[[Iterator[np.ndarray]], np.ndarray]:
    def each(matrices: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(model.sums), len(model.sums)))
        for rows in matrices:
            centred = model.centred(rows)
            total += centred.T @ centred
        return total

    return each


def _spread(model: Whitening) -> Callable[[Iterator[np.ndarray]], tuple]:
    """Count, mean and centred moments of the whitened rows of a partition."""

    def each(matrices: Iterator[np.ndarray]) -> tuple:
        k = model.weights.shape[1]
        found = (0, np.zeros(k), np.zeros((k, k)))
        for rows in matrices:
            white = model.centred(rows) @ model.weights
            mean = white.mean(axis=0)
            found = _joined(found, (len(white), mean, (white - mean).T @ (white - mean)))
        return found

    return each


def _joined(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(distinct: DataFrame, components: int, dimensions: int) -> Whitening:
    """distinct: one column of long arrays of one length, every vector once."""

    def count_and_sum(matrices: Iterator[np.ndarray]) -> tuple[int, list[int]]:
        return _added((0, [0] * dimensions), *[(len(m), _exact_sums(m)) for m in matrices])

    n, sums = _merged(distinct, count_and_sum, dimensions, (0, [0] * dimensions), _added)
    model = Whitening(n, sums, np.zeros((dimensions, 0)), np.zeros(0))
    if not n:
        return model
    cov = _merged(distinct, _moments(model), dimensions, 0.0, lambda a, b: a + b) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    k = min(components, dimensions)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    varies = values > dimensions * np.finfo(np.float64).eps * max(values.max(initial=0.0), 0.0)
    trace = float(np.trace(cov))
    model.explained = np.where(varies, values, 0.0) / trace if trace > 0 else np.zeros(k)
    model.weights = vectors / np.sqrt(np.where(varies, values, np.nan))
    _, _, moments = _merged(distinct, _spread(model), dimensions, (0, np.zeros(k), np.zeros((k, k))), _joined)
    apart = np.abs(moments / n - np.eye(k))[np.ix_(varies, varies)]
    model.identity_error = float(apart.max()) if apart.size else 0.0
    return model


def _added(a: tuple[int, list[int]], *others: tuple[int, list[int]]) -> tuple[int, list[int]]:
    n, sums = a
    for m, more in others:
        n, sums = n + m, [x + y for x, y in zip(sums, more)]
    return n, sums


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", embedding_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, from 1 by falling eigenvalue.

    A vector is usable if it is not null, holds neither null nor non-finite components and has as many as most have (ties: the
    greater number); an empty one has no component and gives no row. The fit counts every distinct x-vector once; repeated
    rows and null ids are projected each. Of fewer dimensions than `components` there are as many components as dimensions. A
    component along which nothing varies (one distinct vector, say) has whitened null and explained 0 and doesn't count in
    identity_error; a deviation that is no long is null. No usable vector: no rows. Other columns are not read.
    More than MAX_DIMENSIONS dimensions are an error.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).alias("vec_id"), scaled(embedding_col, scale).alias("x")).filter(F.size("x") > 0)
    lengths = usable.groupBy(F.size("x").alias("dimensions")).count().orderBy(F.desc("count"), F.desc("dimensions")).first()
    added = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([usable.schema["vec_id"], *[T.StructField(c, kind) for c, kind in added.items()]])
    if lengths is None:
        return spark.createDataFrame([], schema)
    dimensions = lengths["dimensions"]
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {dimensions} dimensions; {MAX_DIMENSIONS} at most can be whitened")
    usable = usable.filter(F.size("x") == dimensions)
    model = fit(written(usable.select("x").distinct()), components, dimensions)
    shipped = spark.sparkContext.broadcast(model)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        k = m.weights.shape[1]
        for batch in batches:
            at = 0
            for rows in _rows(batch.column(1), dimensions):
                each, ids = np.repeat(np.arange(len(rows)), k), batch.column(0).slice(at, len(rows))
                at += len(rows)
                white = (m.centred(rows) @ m.weights).ravel()
                columns = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), m.n, dtype=np.int64)),
                    pa.array(m.deviations(rows), pa.int64()).take(pa.array(each)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(m.explained, len(rows))),
                    pa.array(np.full(len(each), m.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return usable.mapInArrow(run, schema)
