"""What follows from a text alone is computed once for each text that recurs, not once for each line that says it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand in this many rows are computed once; of more than MOST such texts the most frequent, by whole powers of two of the count; none of over LONGEST characters. The rest is computed row by row.
LEAST, MOST, LONGEST = 4, 65_536, 1_000

Hold = Callable[[DataFrame], DataFrame]


def recurring(frame: DataFrame, hold: Hold, text: str = "text") -> DataFrame | None:
    """(text): the texts that recur, few enough to be broadcast, in as many partitions as there are cores; None without any."""
    counts = frame.groupBy(F.col(text).alias(text)).agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST) & (F.length(text) <= LONGEST))
    counted = hold(counts.withColumn("power", F.floor(F.log2("n")).cast("int")))
    total, least = 0, None
    for row in sorted(counted.groupBy("power").count().collect(), reverse=True):
        total += row["count"]
        if total > MOST:
            break
        least = row["power"]
    if least is None:
        return None
    return counted.filter(F.col("power") >= least).select(text).repartition(frame.sparkSession.sparkContext.defaultParallelism)


def by_text(frame: DataFrame, add: Callable[[DataFrame], DataFrame], hold: Hold | None, text: str = "text") -> DataFrame:
    """add(frame), where what add puts in, or makes of the text, follows from the text alone. hold: what to do with the tables of texts, such as writing them; without it every row is computed."""
    texts = None if hold is None else recurring(frame, hold, text)
    if texts is None:
        return add(frame)
    known = hold(add(texts.withColumn("__text", F.col(text))))
    first = add(frame)
    rows = frame.withColumnRenamed(text, "__text")
    once = rows.join(F.broadcast(known), "__text").select(*first.columns)
    rest = add(frame.join(F.broadcast(known.select(F.col("__text").alias(text))), text, "left_anti"))
    return once.unionByName(rest)


def with_column(name: str, value: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda frame: frame.withColumn(name, value)
