"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity, so signatures of
whole documents cannot find it. Containment needs the sketch of the small side alone: an
item's sketch is its k smallest shingle hashes, and every document shingle that is among
them counts as a hit. Items are partitioned by the size of their shingle set; a partition's
largest size u gives k = u - ceil(threshold * u) + 1 hashes for each item, so an item of
which a document holds the threshold's share always hits at least once, and the hits needed
follow from the item's own size. Candidates, told by 128 bits of id and text, are then verified
by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import meet, packed, row_hash, unpacked, written

#: Sketch hashes up to this many (16 bytes each, so 64 MB at most in a hash table) are broadcast; more are joined by shuffle.
BROADCAST_HASHES = 1_000_000
WORD_GAP = r"[^\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _hashes(words: str, size: int) -> Column:
    """A hash for each run of `size` words of the array column; none if there are fewer."""
    last = F.size(words) - size
    at = lambda i, k: F.get(F.col(words), i + k)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.xxhash64(*[at(i, k) for k in range(size)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: str, size: Column) -> Column:
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.array_join(F.slice(F.col(words), i + 1, size), " "))
    return F.when(last >= 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item_id, hash, needed): each item's smallest hashes, and how many of them a document must hold. An item of fewer words than `size` is one shingle."""
    own = _hashes("words", size)
    for n in range(size - 1, 0, -1):
        own = F.when(F.size("words") == n, _hashes("words", n)).otherwise(own)
    hashed = items.select("item_id", F.array_sort(F.array_distinct(own)).alias("hashes")).filter("size(hashes) > 0")
    n = F.size("hashes")
    # Partitions double in size: 1, 2-3, 4-7, 8-15 ...; u is the largest size of the item's partition.
    u = (F.pow(F.lit(2.0), F.length(F.bin(n))) - 1).cast("int")
    k = F.least(n, (u - F.ceil(u * F.lit(threshold) - 1e-9) + 1).cast("int"))
    missing = (n - F.ceil(n * F.lit(threshold) - 1e-9)).cast("int")
    sized = hashed.select("item_id", "hashes", k.alias("k"), F.greatest(F.lit(1), k - missing).alias("needed"))
    return sized.select("item_id", "needed", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("hash"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, containment) for each document that holds at least `threshold` of an item's distinct shingles.

    Words are lower-case runs of letters and digits, so case, punctuation and line breaks do
    not hide a leak. The shingle of an item of fewer than `size` words is its whole sequence. An
    item without any word matches nothing; so do null and empty texts. Rows that repeat a
    document or an item id count as one set of rows: the best containment of the pair is
    returned once. Empty tables give an empty result; other columns are not read.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_hash(F.col(id_col), F.col(text_col)).alias("__key"))
    found = _contained(keyed, items, item_id_col, item_text_col, size, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _contained(keyed: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, size: int, threshold: float) -> DataFrame:
    """(doc_id, __key, item_id, containment) of the rows (doc_id, text, __key) that hold an item."""
    wanted = written(items.select(F.col(item_id_col).alias("item_id"), _tokens(F.col(item_text_col)).alias("words")).filter("size(words) > 0"))
    sketches = item_sketches(wanted, size, threshold)
    few = sketches.count() <= BROADCAST_HASHES
    # Runs of fewer words are hashed only if some item is that short.
    short = [r.n for r in wanted.filter(F.size("words") < size).select(F.size("words").alias("n")).distinct().collect()]
    runs = F.array_distinct(F.concat(*[_hashes("words", n) for n in (size, *sorted(short))]))
    probes = keyed.select("__key", _tokens(F.col("text")).alias("words")).select("__key", F.explode(runs).alias("hash"))
    hits = probes.join(F.broadcast(sketches) if few else sketches, "hash")
    pairs = hits.groupBy("__key", "item_id").agg(F.countDistinct("hash").alias("hits"), F.min("needed").alias("needed")).filter("hits >= needed")
    found = written(pairs.groupBy("__key").agg(F.collect_set(F.struct("item_id")).alias("__items")))
    # Verification: exact shingles of the candidate documents alone, which are read again; no other text is carried to a join.
    held = meet(keyed, found, "__key").filter("__items is not null").select("doc_id", "__key", _tokens(F.col("text")).alias("words"), "__items")
    held = held.select("doc_id", "__key", "words", F.explode("__items").alias("__item"))
    both = held.join(wanted.select(F.col("item_id").alias("__item_id"), F.col("words").alias("item_words")), F.col("__item")["item_id"].eqNullSafe(F.col("__item_id")))
    n = F.least(F.size("item_words"), F.lit(size))
    share = F.size(F.array_intersect(_shingles("item_words", n), _shingles("words", n))) / F.size(_shingles("item_words", n))
    return both.select("doc_id", "__key", F.col("__item_id").alias("item_id"), share.alias("containment")).filter(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold an item of at least `size` words; each row goes by its own text, whatever its id.

    A shorter item is too common a phrase to tell a leak from clean text, so it drops nothing.
    """
    names, key = docs.columns, row_hash(F.col(id_col), F.col(text_col)).alias("__key")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key)
    long = items.filter(F.size(_tokens(F.col(item_text_col))) >= size)
    leaks = written(_contained(keyed, long, item_id_col, item_text_col, size, threshold).select("__key", F.lit(True).alias("leak")).distinct())
    return meet(docs.select(packed(names).alias("all_columns"), key), leaks, "__key").filter("leak is null").select(*unpacked(names, "all_columns"))
