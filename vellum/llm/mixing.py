"""Mixing sources to target weights.

Words are counted per source, every source gets a target by weight, and a document is
emitted floor(rate) times plus once more when a hash of its id, its text and its number among
equal rows falls below the fraction of the rate. Nothing is sampled by a random generator, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, meet, packed, refuse_clash, row_hash, unpacked, word_count, written

#: What mix_sources adds to the id and the kept columns.
ADDED = ("size", "source_size", "target", "copies")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also place: 0, 1, ... by code point, null last.

    Sources are dealt by range and numbered within their range; what comes before a range is the
    sum of the counts of the ranges before it, of which there are as many as partitions.
    """
    order = (F.col("source").isNull(), F.col("source"))
    own = Window.partitionBy("__range").orderBy(*order)
    ranges = written(sizes.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy("__range").count().orderBy("__range").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["__range"], before))
        before += r["count"]
    offsets = sizes.sparkSession.createDataFrame(starts, "__range int, __before long")
    return ranges.join(F.broadcast(offsets), "__range").withColumn("place", F.col("__before") + F.row_number().over(own) - 1).drop("__range", "__before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> the same with target, one row for each source.

    Sources in code point order, null last, take the weights in turn. All targets together
    are `share` of all sizes, split by weight; a target stops at `cap` times its source's
    size and what is left over goes to the others by weight, until none is above. Each round is
    one aggregate over the sources; only its sums reach the driver.
    """
    pick = F.pmod(F.col("place"), F.lit(len(weights))) + 1
    weighted = written(ranked(sizes).select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pick.cast("int")).alias("weight")))
    stop = F.col("source_size") * F.lit(float(cap))
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > stop
        row = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.sum(F.when(above, stop)).alias("stopped"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if row.n == held or not row.open:
            break
        level, held = (float(share) * row["all"] - (row.stopped or 0.0)) / row.open, row.n
    target = stop if level is None or not row.open else F.least(stop, F.lit(level) * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-1",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of docs: its id, size, source_size, target, copies and the kept columns.

    The size is the number of words (null or empty text: 0). A null source is a source of
    its own. A source of size 0 has target 0 and its documents no copies. Every row is drawn for on its own, rows
    whose id is null or repeated too; rows that are equal in id, text and source are numbered. An empty table gives an empty
    result. Other columns are not read; columns to keep that are named as the result's own are an error.
    """
    refuse_clash(keep, ("doc_id", *ADDED))
    source = F.col(source_col)
    own = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), packed(keep).alias("kept"))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    few = written(targets.withColumn("of", row_hash(F.col("source"))).select("of", "source_size", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "number")
    extra = unit_hash(drawn, seed) < rate - F.floor(rate)
    mixed = meet(_numbered(own).withColumn("of", row_hash(F.col("source"))), few, "of")
    return mixed.select("doc_id", "size", "source_size", "target", (F.floor(rate) + extra.cast("long")).alias("copies"), *unpacked(keep, "kept"))


def _numbered(own: DataFrame) -> DataFrame:
    """own with number: 0, or 0, 1, ... among rows of equal id, text and source.

    Only such rows are written and dealt again, by the partition they come from, so that a row that
    repeats without end is no single group; what a partition's rows begin with is a sum over the partitions before it.
    """
    rows = own.withColumn("row", row_hash(F.col("doc_id"), F.col("digest"), F.col("source")))
    repeated = written(rows.groupBy("row").count().filter("count > 1").select("row", F.lit(True).alias("repeats")))
    marked = meet(rows, repeated, "row")
    again = written(marked.filter("repeats").drop("repeats").withColumn("part", F.spark_partition_id()))
    counts = again.groupBy("row", "part").count()
    earlier = Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("row", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("row", "part").orderBy("size"))
    numbers = again.withColumn("within", within).join(begins, ["row", "part"])
    return marked.filter("repeats is null").select(*own.columns, F.lit(0).cast("long").alias("number")).unionByName(numbers.select(*own.columns, (F.col("begin") + F.col("within") - 1).alias("number")))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it, with copy_no from 1 (copy_no_ if docs has a copy_no, and so on)."""
    others = [c for c in docs.columns if c != id_col]
    names = [f"c{i}" for i in range(len(others))]
    own = docs.select(F.col(id_col), *[F.col(c) for c in {params.get("text_col", "text"), params.get("source_col", "source")} - {id_col}], packed(others).alias("all_columns"))
    mixed = mix_sources(own, id_col=id_col, keep=["all_columns"], **params).filter("copies > 0")
    return mixed.select(F.col("doc_id").alias(id_col), *[F.col("all_columns")[n].alias(c) for n, c in zip(names, others)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(fresh("copy_no", docs.columns)))
