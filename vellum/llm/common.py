"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for a null or an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale or the Unicode version."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A local session that names none, as in tests, gets one of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a table of columns in the shared folder, which takes less disk than a checkpoint of rows. Tables of one application share a folder of its name; drop_written removes it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Removes the tables that this application has written, once no result needs them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of a table (a key and a few small columns each, under 64 MB in a hash table) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Beyond it, rows with one key are spread over so many join keys.
SALTS = 16


def meet(rows: DataFrame, few: DataFrame, key: str, broadcast_rows: int | None = None) -> DataFrame:
    """rows left joined with few (one row for each key, no key null), so that long rows aren't shuffled if few can be broadcast.

    Beyond the bound both are shuffled; equal keys are dealt by the partition they come from,
    which a task that runs again shares.
    """
    bound = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    other = few.withColumnRenamed(key, "__of")
    if few.count() <= bound:
        return rows.join(F.broadcast(other), F.col(key) == F.col("__of"), "left").drop("__of")
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("__own", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return spread.join(salted, (F.col(key) == F.col("__of")) & (F.col("__own") == F.col("__salt")), "left").drop("__of", "__own", "__salt")


def packed(names: Sequence[str]) -> Column:
    """The named columns as one struct, so that no name of a caller's meets one of an operator's own; unpacked gives them back."""
    return F.struct(F.lit(True).alias("any"), *[F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])


def unpacked(names: Sequence[str], of: str) -> list[Column]:
    return [F.col(of)[f"c{i}"].alias(c) for i, c in enumerate(names)]


def refuse_clash(kept: Sequence[str], own: Sequence[str]) -> None:
    """Columns to keep that are named as the result's own, or twice, can't both be returned."""
    if clash := sorted({c for c in kept if c in own or list(kept).count(c) > 1}):
        raise ValueError(f"columns to keep are named as the result's own, or twice: {clash}; rename them first")


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores after it until it is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(*columns: Column) -> Column:
    """128 bits that tell rows apart: of 10^12 rows no two are expected to share it. A null differs from any value."""
    known = [F.coalesce(c.cast("string"), F.lit("")) for c in columns] + [c.isNull() for c in columns]
    return F.struct(*[F.xxhash64(F.lit(lane), *known).alias(f"h{lane}") for lane in (1, 2)])


@contextmanager
def as_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Shuffles of jobs that run inside make so many partitions at least; the session's setting is put back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, max(least, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs that run inside pass so many rows at a time to Python, for texts that may be long; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text with A-Z lower-cased, in lists of about `size` bytes, so that a huge text is never split at once."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.end() if gap else len(data)
        if words := data[at:end].lower().split():
            yield words
        at = end


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the key as text leaves the remainder; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
