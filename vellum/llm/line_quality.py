"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What speaks for either are counts of a line's characters and words, cut
into bins, of the line itself and of the lines before and after it; a transition weight joins
neighbours. A document's label is the label of all its lines when the field is learned. Forward
and backward passes give each line's marginal probability of being good, and the mean of
these, weighted by the lines' lengths, is the document's score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fresh, refuse_clash

#: Bounds of the training sample: documents of each label, and characters of each, from a place that a hash tells.
PER_LABEL, MAX_CHARS = 1500, 20_000
BINS, RIDGE, STEPS = 12, 1.0, 60
#: Characters of a document whose words are counted at once, and of documents whose lines are labelled together.
PIECE, TOGETHER = 1 << 19, 1 << 20
#: Classes of characters.
OTHER, SPACE, LOWER, UPPER, DIGIT, SENTENCE, SYMBOL = range(7)
_SENTENCE = set(".,;:?'\"()-–—’‘“”«»¿¡„…")
COUNTS = ["chars", "letters", "upper", "digits", "sentence", "symbols", "doubled", "words", "short", "again", "again_but_one", "capital_words", "bare_words", "symbol_words"]
FEATURES = 15


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point of the first plane; those beyond count as letters."""

    def of(code: int) -> int:
        char, kind = chr(code), unicodedata.category(chr(code))
        if char.isspace():
            return SPACE
        if char in _SENTENCE:
            return SENTENCE
        return {"L": UPPER if kind in ("Lu", "Lt") else LOWER, "M": LOWER, "N": DIGIT, "P": SYMBOL, "S": SYMBOL}.get(kind[0], OTHER)

    return np.array([of(c) for c in range(0x10000)], dtype=np.uint8)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Parts of about PIECE characters that end between words, if a space is near, and the number of the line each begins in."""
    at = line = 0
    while at < len(text) or at == 0:
        end = at + PIECE
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space > at else end
        part = text[at:end]
        yield line, part
        line, at = line + part.count("\n"), max(end, 1)


def line_counts(text: str) -> np.ndarray:
    """A row of COUNTS for each line of the text; lines end at line feeds, and an empty text is one empty line."""
    rows = np.zeros((text.count("\n") + 1, len(COUNTS)))
    for first, part in _pieces(text):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(codes):
            continue
        kind = np.where(codes < 0x10000, _classes()[np.minimum(codes, 0xFFFF)], LOWER)
        feed = codes == 10
        line = first + np.cumsum(feed) - feed
        count = lambda flags, of=line: np.bincount(of[flags], minlength=len(rows))
        mark = (kind == SENTENCE) | (kind == SYMBOL)
        letter = (kind == LOWER) | (kind == UPPER)
        doubled = np.zeros(len(codes), dtype=bool)
        doubled[1:] = mark[1:] & (codes[1:] == codes[:-1])
        for i, flags in enumerate((~feed, letter, kind == UPPER, kind == DIGIT, kind == SENTENCE, kind == SYMBOL, doubled)):
            rows[:, i] += count(flags)
        solid = kind != SPACE
        begins = solid & np.concatenate([[True], ~solid[:-1]])
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        inside = np.arange(len(codes)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        mixed = (inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        name = np.add.reduceat(np.where(solid, codes, 0).astype(np.uint64) * mixed, starts)
        size, letters, upper, symbols = (np.add.reduceat(flags.astype(np.int64), starts) for flags in (solid, letter, kind == UPPER, kind == SYMBOL))
        of = line[starts]
        same = [np.zeros(len(starts), dtype=bool) for _ in range(2)]
        for lag, flags in enumerate(same, 1):
            flags[lag:] = (name[lag:] == name[:-lag]) & (of[lag:] == of[:-lag])
        for i, flags in enumerate((size > 0, size <= 3, same[0], same[1], (upper >= 2) & (upper == letters), letters == 0, symbols > 0), 7):
            rows[:, i] += count(flags, of)
    return rows


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each row of counts."""
    chars, letters, upper, digits, sentence, symbols, doubled, words, *of_words = counts.T
    per = lambda a, b: a / np.maximum(b, 1)
    return np.stack([np.log2(1 + chars), np.log2(1 + words), per(letters, chars), per(upper, letters), per(digits, chars), per(sentence, words), per(symbols, words), per(doubled, words), per(chars, words), *[per(w, words) for w in of_words]], axis=1)


def _chunked(matrices: np.ndarray) -> tuple[np.ndarray, int]:
    """Matrices in rows of about the root of their number, identities at the end."""
    length = max(1, int(np.ceil(np.sqrt(len(matrices)))))
    rows = -(-len(matrices) // length)
    padded = np.concatenate([matrices, np.broadcast_to(np.eye(2), (rows * length - len(matrices), 2, 2))])
    return padded.reshape(rows, length, 2, 2), length


def _running(matrices: np.ndarray) -> np.ndarray:
    """The row vector (1/2, 1/2) times the first, the first two, ... matrices, each scaled to a sum of one.

    Rows of matrices are multiplied side by side, then their products in turn, so n matrices take about two roots of n steps.
    """
    grid, length = _chunked(matrices)
    product = grid[:, 0]
    for t in range(1, length):
        product = np.einsum("nij,njk->nik", product, grid[:, t])
        product = product / product.max(axis=(1, 2), keepdims=True)
    begin = np.empty((len(grid), 2))
    vector = np.array([0.5, 0.5])
    for c, whole in enumerate(product):
        begin[c] = vector
        vector = vector @ whole
        vector = vector / vector.sum()
    out = np.empty(grid.shape[:3])
    for t in range(length):
        begin = np.einsum("ni,nij->nj", begin, grid[:, t])
        begin = begin / begin.sum(axis=1, keepdims=True)
        out[:, t] = begin
    return out.reshape(-1, 2)[: len(matrices)]


@dataclass
class Field:
    """edges: bounds of each feature's bins; own, before, after: features x bins weights of good against bad, the last bin for a line that isn't there; move: log potentials of neighbouring labels, the first's row; start: of a document's first label."""

    edges: list[np.ndarray]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def bins(self, counts: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, side="right") for e, x in zip(self.edges, features(counts).T)], axis=1)

    def evidence(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The log odds that each line's own and neighbouring features give."""
        at = np.arange(bins.shape[1])
        earlier, later = _neighbours(bins, first, last)
        return self.own[at, bins].sum(axis=1) + self.before[at, earlier].sum(axis=1) + self.after[at, later].sum(axis=1)

    def passes(self, evidence: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line: forward and backward vectors (bad, good), scaled, and the matrix into it from the line before."""
        # np.logaddexp keeps both potentials at most one, whatever the evidence.
        good = np.exp(-np.logaddexp(0, -evidence))
        potential = np.stack([1 - good, good], axis=1) + 1e-300
        into = np.exp(self.move) * potential[:, None, :]
        into[first] = (np.exp(self.start) * potential[first])[:, None, :]
        forward = _running(into)
        # Backwards: the transposed matrices from the last line on; those into a first line have equal rows, so nothing crosses a document's bound.
        onward = np.concatenate([into[1:], np.ones((1, 2, 2))])
        onward[last] = 1.0
        backward = _running(onward[::-1].transpose(0, 2, 1))[::-1]
        return forward, backward, into

    def marginals(self, counts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The probability of each line to be good; first, last: flags of the lines at a document's bounds."""
        forward, backward, _ = self.passes(self.evidence(self.bins(counts), first, last), first, last)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)


def _neighbours(bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    earlier, later = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    earlier[first], later[last] = BINS, BINS
    return earlier, later


def fit(texts: Sequence[str], labels: Sequence[int], prior: float) -> Field:
    """texts and labels: the sample, as many of both labels as there are; prior: the share of label 1 among all labelled documents."""
    counts = [line_counts(t) for t in texts]
    lines = np.concatenate(counts)
    sizes = np.array([len(c) for c in counts])
    first, last = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    first[np.cumsum(sizes) - sizes] = True
    label = np.repeat(np.asarray(labels, dtype=np.int64), sizes)
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS)[1:-1])) for x in features(lines).T]
    shape = (FEATURES, BINS + 1)
    field = Field(edges, np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros((2, 2)), np.zeros(2))
    bins = field.bins(lines)
    sides = [bins, *_neighbours(bins, first, last)]
    kinds = 3 * shape[0] * shape[1]

    def spread(x: np.ndarray) -> None:
        field.own, field.before, field.after = x[:kinds].reshape(3, *shape)
        field.move, field.start = x[kinds : kinds + 4].reshape(2, 2), x[kinds + 4 :]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative log likelihood of the labels with a quadratic penalty, and its slope: expected minus observed features."""
        spread(x)
        evidence = field.evidence(bins, first, last)
        forward, backward, into = field.passes(evidence, first, last)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        ahead = np.concatenate([np.full((1, 2), 0.5), forward[:-1]])
        ahead[first] = 0.5
        # passes() scales the potentials of a line to a sum of one: the scale cancels against the label's own.
        scale = np.log(np.einsum("ni,nij->n", ahead, into))
        told = np.where(label == 1, -np.logaddexp(0, -evidence), -np.logaddexp(0, evidence))
        inner = np.flatnonzero(~first)
        steps = field.move[label[inner - 1], label[inner]].sum() + field.start[label[first]].sum()
        value = scale.sum() - told.sum() - steps + RIDGE / 2 * (x @ x)
        apart = good - label
        slope = np.empty_like(x)
        for i, side in enumerate(sides):
            flat = (side + np.arange(FEATURES) * shape[1]).ravel()
            slope[i * kinds // 3 : (i + 1) * kinds // 3] = np.bincount(flat, np.repeat(apart, FEATURES), minlength=kinds // 3)
        pairs = ahead[inner][:, :, None] * into[inner] * backward[inner][:, None, :]
        pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        np.subtract.at(pairs, (label[inner - 1], label[inner]), 1.0)
        slope[kinds : kinds + 4] = pairs.ravel()
        begun = np.array([(1 - good[first]).sum(), good[first].sum()])
        slope[kinds + 4 :] = begun - np.bincount(label[first], minlength=2)
        return value, slope + RIDGE * x

    spread(_least(loss, np.zeros(kinds + 6)))
    share = min(max(prior, 1e-6), 1 - 1e-6)
    held = np.bincount(labels, minlength=2) / len(labels)
    field.start = field.start + np.log(np.array([1 - share, share]) / np.maximum(held, 1e-6))
    return field


def _least(loss, x: np.ndarray) -> np.ndarray:
    """A minimum by L-BFGS with halved steps, STEPS at most."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, used = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            used.append(a)
            way -= a * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.abs(way).sum()))
        for (s, y), a in zip(past, reversed(used)):
            way += (a - (y @ way) / (s @ y)) * s
        step = 1.0
        while step > 1e-8:
            there, new = loss(x - step * way)
            if there <= value - 1e-4 * step * (slope @ way):
                break
            step /= 2
        else:
            break
        s, y = -step * way, new - slope
        if s @ y > 1e-10:
            past = [*past[-7:], (s, y)]
        x, gained = x + s, value - there
        value, slope = there, new
        if gained < 1e-6 * abs(value):
            break
    return x


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float | None]:
    """(text, label) of PER_LABEL documents of each label at most, by a hash of their ids, and the share of label 1 among all that are labelled.

    docs: (doc_id, text); labels: (doc_id, label). Ids that have both labels, or no document, are left out; of rows that repeat an id one is taken, by
    a hash of its text; of a text over MAX_CHARS an excerpt.
    """
    agreed = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    known = agreed.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], None
    # The least hashes lie below a bound that the count tells, so few ids are ranked.
    bound = F.element_at(F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, 2.0 * PER_LABEL * (1 << 40) / n)]), F.col("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    picked = known.filter(F.col("at") <= bound).withColumn("place", place).filter(F.col("place") <= PER_LABEL).select("doc_id", "label", "at")
    start = F.pmod(F.col("at"), F.greatest(F.lit(1), F.length("text") - MAX_CHARS + 1)).cast("int") + 1
    excerpts = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(picked), "doc_id").withColumn("part", F.substring("text", start, F.lit(MAX_CHARS)))
    rows = excerpts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "part", "label")).alias("one")).orderBy("doc_id").select("one.part", "one.label").collect()
    return [(r.part, int(r.label)) for r in rows], counts.get(1, 0) / sum(counts.values())


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score) and the kept columns for each row of docs; learn_from: condition on the rows of labels that may be learned from.

    score: 0 to 1, higher if label 1 is likelier. A null or an empty text is one empty line. If no row of labels may be
    learned from, every score is 0.5; if all have one label, it is that label. Texts are read whole; repeated rows are scored each; an empty
    table gives an empty result; other columns are not read. The sample that is learned from is bounded by PER_LABEL and MAX_CHARS.
    """
    refuse_clash(keep, ("doc_id", "score"))
    rated = labels if learn_from is None else labels.filter(learn_from)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample, prior = training_sample(texts, rated.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")))
    both = len({label for _, label in sample}) == 2
    model = fit([t for t, _ in sample], [label for _, label in sample], prior) if both else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    alike = 0.5 if prior is None else float(prior)

    def together(texts: list[str]) -> np.ndarray:
        counts = [line_counts(t) for t in texts]
        sizes = np.array([len(c) for c in counts])
        ends = np.cumsum(sizes)
        lines = np.concatenate(counts)
        first, last = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
        first[ends - sizes], last[ends - 1] = True, True
        weight = lines[:, 0] + 1
        return np.add.reduceat(shipped.value.marginals(lines, first, last) * weight, ends - sizes) / np.add.reduceat(weight, ends - sizes)

    def scores(column: pa.Array) -> np.ndarray:
        if shipped.value is None:
            return np.full(len(column), alike)
        found, held, chars = [], [], 0
        for cell in column:
            held.append(cell.as_py() or "")
            chars += len(held[-1])
            if chars >= TOGETHER:
                found.append(together(held))
                held, chars = [], 0
        if held:
            found.append(together(held))
        return np.clip(np.concatenate(found), 0.0, 1.0) if found else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64()), *batch.columns[2:]], names)

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(fresh("text", keep)), *keep)
    schema = T.StructType([own.schema.fields[0], T.StructField("score", T.DoubleType()), *own.schema.fields[2:]])
    names = [f.name for f in schema]
    return own.mapInArrow(run, schema)
