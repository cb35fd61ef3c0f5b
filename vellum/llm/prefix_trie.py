"""A prefix trie of conversations, rolled up to all ancestors by pointer jumping.

A node is a distinct sequence of first turns. Its digest is the exclusive or of two 64-bit hashes
of each turn with its position, so the digests of all prefixes are a running sum that is cut into
blocks of rows: a conversation that holds a third of all turns is many blocks. A node's digest
without its last turn is the digest of its parent: these are the edges. In round k every node that
has a 2^k-th ancestor adds what it knows of its subtree to that ancestor and then points twice as
far, so a trie of depth d takes log2(d) rounds. Two sequences share a digest with probability
2^-128; turns that someone made up in order to collide are not guarded against.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written

#: Rows of a block of turns.
BLOCK_ROWS = 1 << 20
#: A node that more than this many nodes point at is looked up by broadcast; of n nodes at most 100,000 are.
HOT, MOST_HOT = 10_000, 100_000
#: Decimal conv_ids joined at a time.
CHUNK_IDS = 1 << 16
NODE = ["id1", "id2"]
UP = ["up1", "up2"]


def turn_digests(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, content, n_bytes): a digest of role and text and the UTF-8 bytes of the text; no text goes further. Rows without an id are no turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))


def _before(rows: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """What the earlier blocks of a conversation give, for each block that goes on with one: at most one row for each block."""
    totals = rows.groupBy("conv_id", "block").agg(value)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = {"place": F.sum, "k1": F.bit_xor, "k2": F.bit_xor}
    value = F.struct(*[summed[n](F.col("total")[n]).over(earlier).alias(n) for n in names])
    return totals.withColumn("before", value).filter(F.col("before")[names[0]].isNotNull()).select("conv_id", "block", "before")


def numbered(digests: DataFrame) -> DataFrame:
    """(conv_id, place, content, n_bytes, block): place 0, 1, ... by turn, null first; turns that repeat a number go by content.

    Rows are dealt by range, so that a long conversation takes many blocks. Equal rows can change places.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("content")]
    spark = digests.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // BLOCK_ROWS))
    dealt = digests.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(blocks, *order, "tie")
    rows = written(dealt.withColumn("block", F.spark_partition_id()).drop("tie"))
    own = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order[1:]))
    before = _before(rows, F.struct(F.count("*").alias("place")).alias("total"), ["place"])
    placed = rows.withColumn("own", own).join(F.broadcast(before), ["conv_id", "block"], "left")
    return placed.select("conv_id", (F.col("own") - 1 + F.coalesce(F.col("before")["place"], F.lit(0))).alias("place"), "content", "n_bytes", "block")


def conversations(places: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first_block, last_block)"""
    return places.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


def branched(places: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first `shared` turns (`most` at most) replaced by those of the conversation `base`: (conv_id, block, place, content, n_bytes) and (conv_id, n_turns, first_block).

    base and shared are expressions on conv_id. A base that is shorter gives all its turns, one that is absent none.
    """
    heads = places.filter((F.col("place") < most) & (F.col("conv_id") == base))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "content", "n_bytes"))).alias("head"))
    own = conversations(places).withColumn("base", base).withColumn("shared", shared)
    taken = F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("shared"))
    convs = own.join(heads, "base", "left").withColumn("head", taken).withColumn("moved", F.col("shared") - F.size("head"))
    convs = convs.withColumn("n_turns", F.size("head") + F.greatest(F.lit(0), F.col("n_turns") - F.col("shared")))
    convs = written(convs.select("conv_id", "n_turns", "first_block", "last_block", "moved", "head"))
    first = convs.select("conv_id", F.col("first_block").alias("block"), F.explode("head").alias("t")).select("conv_id", "block", "t.place", "t.content", "t.n_bytes")
    moves = convs.filter("moved > 0").select("conv_id", "moved", F.explode(F.sequence("first_block", "last_block")).alias("block"))
    rest = places.filter(F.col("place") >= shared).join(moves, ["conv_id", "block"], "left")
    rest = rest.select("conv_id", "block", (F.col("place") - F.coalesce("moved", F.lit(0))).alias("place"), "content", "n_bytes")
    return first.unionByName(rest), convs.select("conv_id", F.col("n_turns").cast("long"), "first_block")


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each conversation and prefix, the empty one too: (conv_id, depth, id1, id2, up1, up2, n_bytes)."""
    keyed = turns.withColumns({f"k{lane}": F.xxhash64(F.lit(lane), "place", "content") for lane in (1, 2)}).drop("content")
    before = _before(keyed, F.struct(*[F.bit_xor(k).alias(k) for k in ("k1", "k2")]).alias("total"), ["k1", "k2"])
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumns({f"run{lane}": F.bit_xor(f"k{lane}").over(so_far) for lane in (1, 2)}).join(F.broadcast(before), ["conv_id", "block"], "left")
    ids = {f"id{lane}": F.col(f"run{lane}").bitwiseXOR(F.coalesce(F.col("before")[f"k{lane}"], F.lit(0))) for lane in (1, 2)}
    prefixes = run.withColumns(ids).select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), *NODE, *[F.col(f"id{lane}").bitwiseXOR(F.col(f"k{lane}")).alias(f"up{lane}") for lane in (1, 2)], "n_bytes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return prefixes.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("id1"), zero.alias("id2"), none.alias("up1"), none.alias("up2"), zero.alias("n_bytes")))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id1, id2, conv_id) -> the node's conv_ids, comma-joined, CHUNK_IDS at most, with the first."""
    held, of = [], None
    for batch in batches:
        out = []
        for *node, conv in zip(*(x.to_pylist() for x in batch.columns)):
            if node != of or len(held) == CHUNK_IDS:
                if held:
                    out.append((*of, held[0], ",".join(map(str, held))))
                held, of = [], node
            held.append(conv)
        yield _batch(out, CHUNKS)
    if held:
        yield _batch([(*of, held[0], ",".join(map(str, held)))], CHUNKS)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> one digest for each node, fed chunk by chunk."""
    of, state = None, None
    for batch in batches:
        out = []
        for *node, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if node == of:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((*of, state.hexdigest()))
            of, state = node, hashlib.sha256(ids.encode())
        yield _batch(out, DIGESTS)
    if state:
        yield _batch([(*of, state.hexdigest())], DIGESTS)


CHUNKS = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256) of (conv_id, id1, id2).

    Ranges of a node's conv_ids are joined where they are; a digest is sequential, so one task takes a node's joined
    ids (about ten bytes a conversation, a chunk at a time) however many there are.
    """
    dealt = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = dealt.mapInArrow(_joined_ids, "id1 long, id2 long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed_ids, "id1 long, id2 long, ends_sha256 string")


def _followed(rows: DataFrame, targets: DataFrame, pointers: DataFrame, n: int) -> DataFrame:
    """rows joined with the columns of the node that (up1, up2) names, if targets has it; pointers: how many rows name each."""
    found = targets.withColumnsRenamed({"id1": "of1", "id2": "of2"})
    on = (F.col("up1") == F.col("of1")) & (F.col("up2") == F.col("of2"))
    hot = pointers.filter(F.col("n") > max(HOT, n // MOST_HOT)).select(F.col("up1").alias("hot1"), F.col("up2").alias("hot2"))
    few = found.join(F.broadcast(hot), (F.col("of1") == F.col("hot1")) & (F.col("of2") == F.col("hot2"))).drop("hot1", "hot2")
    rest = rows.join(F.broadcast(hot), (F.col("up1") == F.col("hot1")) & (F.col("up2") == F.col("hot2")), "left_anti")
    return rest.join(found, on).unionByName(rows.join(F.broadcast(few), on)).drop("of1", "of2")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes (id1, id2, up1, up2, conv_id, depth, leaves, saved, n_children) -> the same with parent_conv_id and the sums of leaves and saved over each subtree."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = nodes.filter("depth > 0").select(*NODE, *UP, "leaves", "saved")
    lifted, parents = [], None
    step = 1
    while step <= deepest:
        n = active.count()
        to = written(active.groupBy(*UP).agg(*sums))
        lifted.append(to.drop("n"))
        if parents is None:
            parents = _followed(nodes.select(*NODE, *UP), nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), to, n).select(*NODE, "parent_conv_id")
        step *= 2
        if step <= deepest:
            more = to.select(F.col("up1").alias("id1"), F.col("up2").alias("id2"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            grown = active.join(more, NODE, "left").select(*NODE, *UP, *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")])
            jumps = active.select(*NODE, F.col("up1").alias("to1"), F.col("up2").alias("to2"))
            active = written(_followed(grown, jumps, to, n).select(*NODE, F.col("to1").alias("up1"), F.col("to2").alias("up2"), "leaves", "saved"))
    if parents is None:
        return nodes.withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = lifted[0]
    for to in lifted[1:]:
        below = below.unionByName(to)
    below = below.groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return nodes.join(below, NODE, "left").join(parents, NODE, "left").select(*NODE, *UP, "conv_id", "depth", "n_convs", "n_children", "parent_conv_id", *whole)


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (longs) and ends_sha256.

    turns: (conv_id, block, place, content, n_bytes); convs: (conv_id, n_turns, ...), those without a turn too. saved_tokens
    sums over the subtree what each node's last text would cost for all members but one, in bytes; ends_sha256 is the digest of
    the ascending conv_ids that end at the node. No conversations: no nodes, not even a root.
    """
    rows = written(memberships(turns, convs))
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("up1").alias("up1"), F.max("up2").alias("up2"))
    nodes = written(nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).select(*NODE, *UP, "conv_id", "depth", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    # The deepest prefix of a conversation is where it ends.
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("at")).select("conv_id", "at.id1", "at.id2")
    whole = rolled_up(written(counted)).join(ends_digests(last), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of the conversations of turns as they are; see trie_nodes for the result.

    Rows are taken by turn, null first, those of equal turn by a digest of role and text; a repeated row is a turn of its own. A null role or text is empty, a null id no conversation. Other columns are not read.
    """
    places = numbered(turn_digests(turns, **columns))
    convs = conversations(places)
    return trie_nodes(places, convs)
