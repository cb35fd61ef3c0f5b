"""The prefix trie, whitening and the line field against brute-force versions, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import line_quality, prefix_trie, queries, whitening
from vellum.llm.common import held_out

TURNS = "conv_id long, turn long, role string, text string, depth int, id1 string, block string, n_convs string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, "y") for r in rows], TURNS)


def brute_trie(sequences):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def rows_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def ordered(rows):
    """Conversations by turn, null first; repeated turns by the digest of role and text."""
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in found.items()}


ODD = [(None, 1, "u", "gone"), (1, None, None, None), (1, 2, "user", "é"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "b"), (3, None, None, ""), (3, 1, "user", "a"), (-4, 0, "x", "long " * 50_000), (-9, 5, "", "user1:"), (-8, 5, "user", "1:")]


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 40)  # so that conversations go over blocks
    monkeypatch.setattr(prefix_trie, "HOT", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = list(ODD) if seed == 0 else []
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 130 if c < 4 else 3])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice("ab") if t < 100 else "same"))
    got = rows_of(prefix_trie.prefix_trie(turns_of(spark, rows).repartition(3)))
    assert got == brute_trie(ordered(rows))


def test_trie_of_a_hot_conversation_and_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 100)
    rows = [(7, t, "user", f"{t % 3}") for t in range(700)] + [(100 + c, t, "user", "copy") for c in range(300) for t in range(2)]
    assert rows_of(prefix_trie.prefix_trie(turns_of(spark, rows))) == brute_trie(ordered(rows))


@pytest.mark.parametrize("shorter", [False, True])
def test_branches_equal_brute_force(spark, monkeypatch, shorter):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 30)
    rng = random.Random(5)
    ids = [c for c in range(-20, 80) if not (shorter and c % 10 == 5)]
    rows = [(c, t, "user", rng.choice("ab")) for c in ids for t in range(rng.randrange(1, 4 if shorter else 14))]
    own, want = ordered(rows), {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        want[c] = own.get(base, [])[:h] + seq[h:]
    places = prefix_trie.numbered(prefix_trie.turn_digests(turns_of(spark, rows)))
    conv = F.col("conv_id")
    shared = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    assert rows_of(prefix_trie.trie_nodes(*prefix_trie.branched(places, conv - conv % 5, shared, 8))) == brute_trie(want)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turns_of(spark, [(None, 1, "u", "x")])).count() == 0


# 12: whitening


def whitened(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, n int, component string, whitened double")
    return whitening.whiten(frame)


def check_whitening(found, vectors, scale=256):
    """The rows of {vec_id: vector}, distinct ids, against numpy on exact integers."""
    x = {i: [int(np.floor(scale * c)) for c in v] for i, v in vectors.items()}
    fit = [list(map(int, r)) for r in sorted({tuple(r) for r in x.values()})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs, k = values[::-1], vecs[:, ::-1], min(4, len(sums))
    by = defaultdict(dict)
    for r in found:
        by[r.vec_id][r.component] = r
    assert set(by) == set(x) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    for c in range(1, k + 1):
        got = np.array([by[i][c].whitened for i in x])
        want = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x.values()]) @ vecs[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(got @ want)
        assert np.allclose(got, sign * want, atol=1e-7)
    for i, r in x.items():
        for row in by[i].values():
            assert row.n == n and row.deviation == sum((n * a - s) ** 2 for a, s in zip(r, sums))
            assert row.explained == pytest.approx(values[row.component - 1] / values.sum(), rel=1e-9) and row.identity_error < 1e-6


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_whitening_equals_numpy(spark, offset):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(7, 7)) * np.array([5, 3, 2, 1, 0.5, 0.2, 0.1])
    vectors = {i: (offset + (rng.normal(size=7) @ mix)).tolist() for i in range(400)} | {1000 + i: [offset] * 7 for i in range(200)}
    check_whitening(whitened(spark, list(vectors.items())).repartition(3).collect(), vectors)


def test_whitening_of_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(queries.op12_whitening(spark, sf_dir).collect(), {r.vec_id: r.embedding for r in rows})


def test_whitening_of_odd_vectors(spark):
    assert whitened(spark, []).count() == 0 and whitened(spark, [(1, None), (2, []), (3, [None, 1.0])]).count() == 0
    one = whitened(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in one)
    mixed = whitened(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [float("inf"), 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1e300, 0.0])]).collect()
    assert {r.vec_id for r in mixed} == {1, 2} and [r.whitened is None for r in sorted(mixed, key=lambda r: r.component)] == [False, False, True, True]
    huge = whitened(spark, [(1, [1e15]), (2, [0.0])]).collect()
    assert [r.deviation for r in huge] == [None, None] and sorted(r.whitened for r in huge) == pytest.approx([-1.0, 1.0])
    with pytest.raises(ValueError):
        whitened(spark, [(1, [0.0] * (whitening.MAX_DIMENSIONS + 1))])


# 13: the field over lines


def brute_marginals(evidence, move, start):
    """By all 2^n labellings."""
    n, total, good = len(evidence), 0.0, np.zeros(len(evidence))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        p = np.exp(start[y[0]] + sum(e * v for e, v in zip(evidence, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total


def field_of(rng):
    shape = (line_quality.FEATURES, line_quality.BINS + 1)
    return line_quality.Field([np.arange(3.0)] * line_quality.FEATURES, *(rng.normal(size=shape) for _ in range(3)), rng.normal(size=(2, 2)), rng.normal(size=2))


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(2)
    field, texts = field_of(rng), ["a b\nB!!\n\n1 2 3 | 4", "one line", "", "x\ny y\nZ\n&&& b\nc\nd d d"]
    counts = [line_quality.line_counts(t) for t in texts]
    sizes = np.array([len(c) for c in counts])
    first, last = np.zeros(sizes.sum(), bool), np.zeros(sizes.sum(), bool)
    first[np.cumsum(sizes) - sizes], last[np.cumsum(sizes) - 1] = True, True
    lines = np.concatenate(counts)
    evidence = field.evidence(field.bins(lines), first, last)
    want = np.concatenate([brute_marginals(e, field.move, field.start) for e in np.split(evidence, np.cumsum(sizes)[:-1])])
    assert np.allclose(field.marginals(lines, first, last), want)


def test_counts_of_a_line_do_not_depend_on_the_pieces(monkeypatch):
    text = "Some words words here, 12 of THEM!!\n" * 40 + "| a | b &&& ccc\n\nlast " + "tail tail " * 60
    whole = line_quality.line_counts(text)
    monkeypatch.setattr(line_quality, "PIECE", 200)
    pieces = line_quality.line_counts(text)
    again = [line_quality.COUNTS.index(c) for c in ("again", "again_but_one", "doubled")]  # a repeat across a cut is not seen
    assert whole.shape == (43, len(line_quality.COUNTS)) and (np.delete(whole, again, 1) == np.delete(pieces, again, 1)).all()
    row = dict(zip(line_quality.COUNTS, line_quality.line_counts("The The big &&& OLD!! 7")[0]))
    assert row == {"chars": 23, "letters": 12, "upper": 5, "digits": 1, "sentence": 0, "symbols": 5, "doubled": 3, "words": 6, "short": 5, "again": 1, "again_but_one": 0, "capital_words": 1, "bare_words": 2, "symbol_words": 2}


def test_quality_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in queries.op13_line_quality(spark, sf_dir).collect()}
    assert len(scored) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(0 <= r.score <= 1 for r in scored.values())
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(scored[r.doc_id].held_out for r in labels)
    good, bad = ([scored[r.doc_id] for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.2
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.97


def test_quality_learns_from_the_allowed_labels_alone(spark):
    docs = spark.createDataFrame([(i, ("fine words that go on and on" if i % 2 else "BAD!! | BAD!! | BAD!!") + f" {i}", "en") for i in range(60)], "doc_id long, text string, score string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    lies = truth.unionByName(spark.createDataFrame([(i, 1 - i % 2) for i in range(30, 60)], "doc_id long, quality int"))
    run = lambda labels, **how: {r.doc_id: round(r.score, 9) for r in line_quality.score_quality(docs, labels, **how).collect()}
    own = run(truth)
    assert own == run(lies, learn_from=F.col("doc_id") < 30)
    assert all((s > 0.5) == bool(i % 2) for i, s in own.items())


def test_quality_of_odd_tables(spark):
    long = "fine words that go on and on\n" * 20_000
    rows = [(None, None), (1, ""), (2, None), (3, " \n\n"), (4, "x" * 3_000_000), (5, long), (6, "fine words here"), (6, "fine words here"), (7, "BAD!! | &&&"), (8, "BAD!! | &&&")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, text_ string")
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (8, 0), (8, 1), (None, 1), (99, 0), (1, 5), (2, None)], "doc_id long, quality int")
    found = line_quality.score_quality(docs, labels, keep=["text_"]).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.text_ == "k" for r in found)
    same = [r.score for r in found if r.doc_id == 6]
    assert len(same) == 2 and same[0] == same[1] and len({r.score for r in found if r.doc_id in (None, 1, 2)}) == 1
    none = labels.limit(0)
    assert {r.score for r in line_quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in line_quality.score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert line_quality.score_quality(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        line_quality.score_quality(docs.withColumn("score", F.lit(1)), labels, keep=["score"])
