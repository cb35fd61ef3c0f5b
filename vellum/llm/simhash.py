"""SimHash near-dedup with bit-sliced comparison.

Documents with one fingerprint are one node. With the 64 bits cut into radius + 2 parts, two
fingerprints within the radius agree on two parts at least, so the nodes are grouped by every
two parts. A group of more than BLOCK nodes is dealt into blocks, and each pair of its blocks
is compared on its own, so no task holds an unbounded group and no pair is left out.

Pairs are compared many at a time: the differing bits of 64 pairs make one word of each bit
plane, carry-save counters add the planes up, and words in which all pairs exceed the radius
are abandoned. A group reports its links as one star for each of its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed, small_batches, word_lists
from vellum.llm.components import connected_components, with_root

#: Nodes of a block on average, pairs compared at a time, and words that are abandoned together.
BLOCK, PAIRS, WORDS = 512, 1 << 17, 16
#: Fingerprints of more rows than this are joined by broadcast: there are no more of them than rows / HEAVY.
HEAVY = 100_000


def fingerprint(data: bytes, size: int = 3, seed: int = 42) -> int:
    """Bit k is 1 if it is set in over half the hashes of the shingles, repeats included; 0 without any word."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    carry: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in word_lists(data):
        words = carry + words
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - size + 1
        if n > 0:
            hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist())), dtype=np.uint64, count=n)
            for i in range(0, n, 1 << 15):
                part = hashes[i : i + (1 << 15)]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        carry = words[max(0, n) :] if n > 0 else words
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    bits = (2 * counts > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", size) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def within_radius(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] (uint64) differ in `radius` bits at most, by vertical counters."""
    n = len(a)
    words = -(-n // (64 * WORDS)) * WORDS
    differ = np.full(words * 64, np.iinfo(np.uint64).max, dtype=np.uint64)
    differ[:n] = a ^ b
    bits = np.unpackbits(differ.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)  # plane k, word w: bit k of pairs 64 w ...
    n_counters = radius.bit_length()
    out = np.zeros(words, dtype=np.uint64)
    live = np.arange(words)
    counters = np.zeros((n_counters, words), dtype=np.uint64)
    over = np.zeros(words, dtype=np.uint64)
    for k in range(0, 64, 8):
        for plane in planes[k : k + 8, live]:
            carry = plane
            for c in counters:
                c ^= carry
                carry = carry & ~c
            over |= carry  # 2 ** n_counters differing bits
        done = over.copy()
        if (1 << n_counters) - 1 > radius:
            done |= _greater(counters, radius)
        keep = (~done).reshape(-1, WORDS).any(axis=1)
        if not keep.all():
            lanes = np.repeat(keep, WORDS)
            live, counters, over, done = live[lanes], counters[:, lanes], over[lanes], done[lanes]
        if not len(live):
            return np.zeros(n, dtype=bool)
    out[live] = ~done
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:n].astype(bool)


def _greater(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above, equal = above | (equal & counters[i]), equal & ~counters[i]
    return above


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between nodes of one group; side: 0 for a block against itself, else 1 or 2."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    left, right = [], []
    held_a, held_b, held = [], [], 0

    def flush() -> None:
        nonlocal held_a, held_b, held
        if held:
            a, b = np.concatenate(held_a), np.concatenate(held_b)
            near = within_radius(fp[a], fp[b], radius)
            left.append(a[near])
            right.append(b[near])
        held_a, held_b, held = [], [], 0

    for shift in range(1, int(sizes.max(initial=1))):
        big = sizes > shift
        starts, sizes = starts[big], sizes[big]
        n = sizes - shift
        a = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
        b = a + shift
        fit = (side[a] == 0) | (side[a] != side[b])
        held_a.append(a[fit])
        held_b.append(b[fit])
        held += len(held_a[-1])
        if held >= PAIRS:
            flush()
    flush()
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = _stars(len(fp), a, b)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints (column fp) that chains within the radius connect."""
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    value = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(parts)]
    keys = [F.struct(F.lit(t).alias("t"), (F.shiftleft(value[i], 32) + value[j]).alias("key")) for t, (i, j) in enumerate(combinations(range(parts), 2))]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    counts = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = dealt.join(counts, ["t", "key"])
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = shared.withColumn("own", F.pmod(F.xxhash64("fp"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    # A block meets itself once; of two blocks both sides get the same group.
    grouped = blocked.select(
        F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), side.cast("byte").alias("side"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def close(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b = _links(*(np.concatenate(x) for x in zip(*parts)), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            group, side, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(group):
                continue
            fp = fp.view(np.uint64)
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            if held and (cut or held[-1][0][-1] != group[0]):
                # What is held and this batch's part of the same group end before the last group.
                if cut:
                    held.append((group[:cut], side[:cut], fp[:cut]))
                yield close(held)
                held = []
            elif cut:
                yield close([(group[:cut], side[:cut], fp[:cut])])
            held.append((group[cut:], side[cut:], fp[cut:]))
        if held:
            yield close(held)

    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints are over shingles of `size` words (fewer words: the whole sequence; none or
    null: 0, linked like any other). component_id is the smallest doc_id that links reach, the
    row's own included; null ids have none of their own and take their component's. Repeated
    rows are returned each; an empty table gives an empty result; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        marked = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    # Only copies and linked fingerprints can have a component that isn't their own row's id.
    rooted = nodes.join(roots, "fp", "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "__root")
    found = checkpointed(with_root(rooted, "root", least, "fp").select(F.col("fp").alias("of"), "component_id", "n"))
    heavy = found.filter(F.col("n") > HEAVY).select(F.col("of").alias("heavy"), F.col("component_id").alias("heavy_id"))
    light = found.filter(F.col("n") <= HEAVY).drop("n")
    # Rows of a heavy fingerprint have their component already; in the second join they are dealt by id.
    first = marked.join(F.broadcast(heavy), marked["fp"] == heavy["heavy"], "left")
    dealt = first.withColumn("key", F.when(F.col("heavy").isNull(), F.struct(F.lit(True).alias("light"), F.col("fp").alias("of"))).otherwise(F.struct(F.lit(False).alias("light"), F.xxhash64("doc_id").alias("of"))))
    joined = dealt.join(light.select(F.struct(F.lit(True).alias("light"), "of").alias("key"), "component_id"), "key", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("heavy_id", "component_id", "doc_id").alias("component_id"))
