"""Language-model scores from a log-frequency Bloom filter.

Documents are read in batches; a task tallies the unigrams and bigrams of a batch by 64-bit
hash, packs them by shard, and the shards' counts are merged without any row for a single
n-gram. Quantised to level 1 + floor(log2(count)), an n-gram is a member of one filter for
each level up to its own; a shard has filters sized by their members. A shard probes its
filters, level after level until one fails, for all n-grams of each batch and sends the
levels back to the batch, so no process holds more than one shard's filters and every level
counts, however large the input. A bigram's share of its context's count is mixed with
the add-one unigram probability; by the least and greatest counts of the levels, the probabilities of
all tokens after a context sum to one at most. The filter of one shard is small and local: broadcasting all of
them would put filters that grow with the corpus into every worker.

The base score needs exact unigram counts: those of the most frequent words, as many as
FREQUENT, are broadcast; all others meet the documents' rare words in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import as_partitions, small_batches, word_lists, written

#: Bytes of text that make a batch (about a million tokens), and exact counts that are broadcast at most.
BATCH_BYTES, FREQUENT = 6 << 20, 1 << 19
#: Bytes of all texts that a shard's n-grams come from.
SHARD_BYTES = 24 << 20
BITS_PER_MEMBER, PROBES, LEVELS = 8, 5, 40
#: Share of the bigram estimate in a smoothed probability.
LAMBDA = 0.6
UNIGRAM, BIGRAM = 0, 1
_END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line break


def token_hashes(data: bytes) -> np.ndarray:
    """One uint64 for each word of the text, A-Z lower-cased, and one for the end."""
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)) for words in word_lists(data)]
    return np.concatenate([*parts, np.array([_END], dtype=np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bigram_hashes(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each token with the one before it, and that one; before a text's first token stands an end. ends: where texts end in tokens."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], ends[:-1]))] = _END
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens), before


def tally(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sum of their counts (1 each if not given)."""
    order = np.argsort(hashes, kind="stable") if counts is not None else None
    hashes = hashes[order] if order is not None else np.sort(hashes)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], first) if counts is not None and len(first) else np.diff(np.append(first, len(hashes)))
    return hashes[first], sums.astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return (np.frexp(counts.astype(np.float64))[1]).astype(np.int64)  # 1 + floor(log2(count))


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.exp2(np.maximum(level, 1) - 1), 0.0)


def most_count(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level."""
    return np.exp2(level) - 1


def smoothed_share(both: np.ndarray, context: np.ndarray, alone: np.ndarray, norm: float) -> np.ndarray:
    """The probability of a token after its context, by the levels of the two together, the context and the token.

    The bigram's least count over the context's greatest, mixed with the add-one share of the token's least count: over all
    tokens either sums to one at most, so the mixture does. After a context that was not learned from it is the token's share alone.
    """
    single = (least_count(alone) + 1) / norm
    return np.where(context > 0, LAMBDA * np.minimum(least_count(both) / np.maximum(most_count(context), 1), 1.0) + (1 - LAMBDA) * single, single)


def _probes(hashes: np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    step = mixed(hashes + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * step) % np.asarray(bits, dtype=np.uint64)


def make_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(-(-len(hashes) * BITS_PER_MEMBER // 64) * 64, dtype=bool)
    for at in _probes(hashes, len(bits)) if len(hashes) else ():
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Filters:
    """Filters, one after the other; starts and bits: byte and size of each by [kind][level][shard]."""

    shards: int
    data: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    lowest: tuple[int, int]

    def level(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The highest level up to which all filters hold each hash; 0 if none does."""
        found, alive = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        shard = shard_of(hashes, self.shards)
        for level in range(self.lowest[kind], LEVELS + 1):
            size = self.bits[kind, level, shard[alive]]
            alive, size = alive[size > 0], size[size > 0]
            if not len(alive):
                break
            held = np.ones(len(alive), dtype=bool)
            base = self.starts[kind, level, shard[alive]]
            for at in _probes(hashes[alive], size):
                at = at.astype(np.int64)
                held &= (self.data[base + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[held]
            found[alive] = level
        return found


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def stable(frame: DataFrame) -> DataFrame:
    """The frame, written first if a shuffle makes it: its rows could come in another order when it is read again."""
    return written(frame) if "Exchange" in frame._jdf.queryExecution().executedPlan().toString() else frame


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Name and rows of each batch of a partition of (doc_id, text_hash, text, learned). The name tells the rows, so a reading that batches them otherwise is noticed."""
    held, size, number = [], 0, 0

    def closed() -> tuple[str, pa.Table]:
        whole = pa.Table.from_batches(held)
        digest = int(whole["text_hash"].to_numpy().sum(dtype=np.int64))
        return f"{TaskContext.get().partitionId()}.{number}.{len(whole)}.{digest}", whole

    for batch in batches:
        start = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            size += length
            if size >= BATCH_BYTES:
                held.append(batch.slice(start, i + 1 - start))
                yield closed()
                held, size, number, start = [], 0, number + 1, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield closed()


def _packed(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of distinct, sorted hashes by shard, and (shard, from, to) for each shard that has some."""
    shard = shard_of(hashes, shards)
    order = np.argsort(shard, kind="stable")
    held, first = np.unique(shard[order], return_index=True)
    return order, list(zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def ngram_levels(keyed: DataFrame, shards: int) -> DataFrame:
    """(batch, kind, shard, levels, h, c): for each batch of all rows, kind and shard the levels of the batch's distinct n-grams, sorted by hash, one byte each; and exact unigram counts of the learned rows (h and c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in text_batches(batches):
            tokens = [token_hashes(x.as_py() or b"") for x in table["text"]]
            sizes = np.array([len(t) for t in tokens])
            ends, joined = np.cumsum(sizes), np.concatenate(tokens)
            once = np.repeat(table["learned"].to_numpy().astype(np.int64), sizes)
            rows: list[tuple] = []
            for kind, hashes in ((UNIGRAM, joined), (BIGRAM, bigram_hashes(joined, ends)[0])):
                hashes, counts = tally(hashes, once)
                order, cuts = _packed(hashes, shards)
                rows += [(name, kind, s, hashes[order[a:b]].tobytes(), counts[order[a:b]].astype(np.uint32).tobytes()) for s, a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["batch", "kind", "shard", "hashes", "counts"])

    def merge(_key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = shard = None
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        asked: list[tuple[str, np.ndarray]] = []
        for part in parts:
            kind, shard = part["kind"][0].as_py(), part["shard"][0].as_py()
            more = [np.frombuffer(x.as_py(), np.uint64) for x in part["hashes"]]
            n = [np.frombuffer(x.as_py(), np.uint32) for x in part["counts"]]
            asked += zip(part["batch"].to_pylist(), more)
            learned = [x > 0 for x in n]
            hashes, counts = tally(np.concatenate((hashes, *(x[k] for x, k in zip(more, learned)))), np.concatenate((counts, *(x[k] for x, k in zip(n, learned)))))
        filters = shard_filters(kind, hashes, levels_of(counts))
        for name, probed in asked:
            yield row([name], [kind], [shard], [filters.level(kind, probed).astype(np.uint8).tobytes()], [None], [None])
        for a in range(0, len(hashes) if kind == UNIGRAM else 0, 50_000):
            part, n = hashes[a : a + 50_000].view(np.int64), counts[a : a + 50_000]
            none = [None] * len(n)
            yield row(none, [kind] * len(n), [shard] * len(n), none, part, n)

    def row(*columns) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["batch", "kind", "shard", "levels", "h", "c"])

    blobs = keyed.mapInArrow(count, "batch string, kind int, shard int, hashes binary, counts binary")
    return blobs.groupBy("kind", "shard").applyInArrow(merge, "batch string, kind int, shard int, levels binary, h long, c long")


def shard_filters(kind: int, hashes: np.ndarray, levels: np.ndarray) -> Filters:
    """The filters of all levels of one shard's n-grams of one kind; they know of no other shard."""
    starts, bits = (np.zeros((2, LEVELS + 2, 1), dtype=np.int64) for _ in range(2))
    data, size = [np.zeros(0, np.uint8)], 0
    for level in range(1, int(levels.max(initial=0)) + 1):
        made = np.frombuffer(make_filter(hashes[levels >= level]), dtype=np.uint8)
        starts[kind, level, 0], bits[kind, level, 0] = size, len(made) * 8
        data.append(made)
        size += len(made)
    return Filters(1, np.concatenate(data), starts, bits, (1, 1))


def frequent_counts(unigrams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of all unigrams from a least count on, the least power of two for which there are FREQUENT of them at most."""
    # Counts by their power of two; the words left out each hold 1 / FREQUENT of all tokens at most, as so many are as frequent.
    by_count = unigrams.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    left, least = FREQUENT, None
    for r in by_count:
        if r["count"] > left:
            break
        left, least = left - r["count"], 1 << r["power"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = unigrams.filter(F.col("c") >= least).toArrow()
    hashes, counts = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    learn_from: condition on the rows of docs that are counted (default: all). Tokens are the
    words and one end, so a null or empty text has one token. base_score is the add-one unigram
    log10 probability by exact counts, score the model's log10 probability of the text; see smoothed_share. If nothing is learned from, counts and
    train_tokens are 0 and each token has probability 1. Repeated rows are counted and returned
    each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    learned = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    text = F.col(text_col)
    keyed = stable(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"), learned.alias("learned")))
    # As many shards as keep one to SHARD_BYTES of text, each with its share of all n-grams.
    size = keyed.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    with small_batches(spark), as_partitions(spark, shards):
        counted = written(ngram_levels(keyed, shards))
    unigrams = counted.filter("h is not null").select("h", "c")
    total, distinct = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = float(total + distinct + 1)
    shipped = spark.sparkContext.broadcast(frequent_counts(unigrams))

    def levels(answers: dict[tuple[int, int], bytes], kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and the level of each by the shards' answers."""
        found = np.unique(hashes)
        order, cuts = _packed(found, shards)
        level = np.zeros(len(found), dtype=np.int64)
        for s, a, b in cuts:
            level[order[a:b]] = np.frombuffer(answers[kind, s], np.uint8)
        return found, level

    def smoothed(single: tuple[np.ndarray, np.ndarray], double: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        pairs, before = bigram_hashes(tokens, ends)
        level = lambda known, hashes: known[1][np.searchsorted(known[0], hashes)]
        return np.log10(np.minimum(smoothed_share(level(double, pairs), level(single, before), level(single, tokens), norm), 1.0))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in text_batches(batches):
            for batch in table.select(["doc_id", "text_hash", "text"]).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), *batch.columns], ["batch", "doc_id", "text_hash", "text"])

    def score(rows: pa.Table, answered: pa.Table) -> pa.Table:
        hashes, counts = shipped.value
        answers = {(k, s): x for k, s, x in zip(*(answered[c].to_pylist() for c in ("kind", "shard", "levels")))}
        rows = rows.select(["doc_id", "text_hash", "text"]).combine_chunks()
        token_lists = [token_hashes(x.as_py() or b"") for x in rows["text"]]
        whole_ends, whole_tokens = np.cumsum([len(t) for t in token_lists]), np.concatenate(token_lists)
        single, double = levels(answers, UNIGRAM, whole_tokens), levels(answers, BIGRAM, bigram_hashes(whole_tokens, whole_ends)[0])
        # The end before a text is a token of the batch: each text has one.
        out, first = [], 0
        for batch in rows.to_batches():
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                tokens = token_lists[first : first + part.num_rows]
                first += part.num_rows
                ends = np.cumsum([len(t) for t in tokens])
                starts, joined = np.concatenate(([0], ends[:-1])), np.concatenate(tokens)
                at = np.searchsorted(hashes, joined)
                at[at == len(hashes)] = 0
                known = hashes[at] == joined if len(hashes) else np.zeros(len(joined), dtype=bool)
                value = np.where(known, np.log10((counts[at] + 1.0) / norm) if len(hashes) else 0.0, 0.0)
                row, rare, times = _rare_words(joined, ~known, ends)
                sums = [np.add.reduceat(x, starts) for x in (value, smoothed(single, double, joined, ends))]
                n_known = np.add.reduceat(known.astype(np.int64), starts)
                n, m = part.num_rows, len(rare)
                whole, none = pa.nulls, np.zeros
                columns = [
                    pa.concat_arrays([part.column(0), part.column(0).take(pa.array(row))]),
                    pa.concat_arrays([part.column(1), part.column(1).take(pa.array(row))]),
                    np.concatenate((ends - starts, times)),
                    np.concatenate((n_known, none(m, np.int64))),
                    np.concatenate((sums[0], none(m))),
                    np.concatenate((sums[1], none(m))),
                    pa.concat_arrays([whole(n, pa.int64()), pa.array(rare.view(np.int64))]),
                ]
                out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "text_hash", "n", "known", "base", "model", "h"]))
        return pa.Table.from_batches(out)

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    texts = keyed.mapInArrow(named, f"batch string, doc_id {id_type}, text_hash long, text binary")
    answers = counted.filter("batch is not null").select("batch", "kind", "shard", "levels")
    scored = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"doc_id {id_type}, text_hash long, n long, known long, base double, model double, h long")
    with small_batches(spark), as_partitions(spark, shards):
        held = written(scored)
    shipped.destroy()  # else idle workers keep every call's counts
    return _with_rare_words(held, unigrams, total, norm)


def _rare_words(tokens: np.ndarray, rare: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and times of each distinct rare token of each text."""
    at = np.flatnonzero(rare)
    row, found = np.searchsorted(ends, at, side="right"), tokens[at]
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (found[1:] != found[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[first], found[first], np.diff(np.append(first, len(row)))


def _with_rare_words(scored: DataFrame, unigrams: DataFrame, total: int, norm: float) -> DataFrame:
    """Adds the rare words' exact counts to what each row has so far; rows with h are words of a document, n times each, the others documents."""
    rare = scored.filter("h is not null").select("h", "doc_id", "text_hash", F.col("n").alias("count"))
    joined = rare.join(unigrams, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    words = joined.select(
        "doc_id",
        "text_hash",
        F.lit(0).cast("long").alias("n"),
        F.when(F.col("c") > 0, F.col("count")).otherwise(F.lit(0)).alias("known"),
        (F.col("count") * F.log10((F.col("c") + 1) / F.lit(norm))).alias("base"),
        F.lit(0.0).alias("model"),
        F.lit(0).cast("long").alias("rows"),
    )
    direct = scored.filter("h is null").drop("h").withColumn("rows", F.lit(1).cast("long"))
    sums = direct.unionByName(words).groupBy("doc_id", "text_hash").agg(*[F.sum(x).alias(x) for x in ("n", "known", "base", "model", "rows")])
    # Equal rows were summed into one; each gets its share again.
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    whole = lambda x: (F.col(x) / F.col("rows")).cast("long")
    return each.select(
        "doc_id",
        whole("n").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("model") / F.col("rows")).alias("score"),
    )
