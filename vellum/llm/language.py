"""Language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams of length 1 to 3 (lower-case, runs of anything but
letters as one space). The presence kernel of two texts counts the n-grams that both hold,
normalised. A few texts of each language are Nystroem landmarks: a text's features are its
kernels with them, whitened by the landmarks' own kernel matrix. One-versus-rest kernel ridge
regression on these features scores every language by batched matrix products.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fresh, refuse_clash

#: Bounds of the training sample: texts a language and characters a text, and landmarks among them.
PER_LANGUAGE, MAX_CHARS, LANDMARKS = 300, 20_000, 32
#: Bounds of all languages together: the most frequent ones are learned, and with many of them fewer texts and landmarks of each.
MAX_LANGUAGES, MAX_TEXTS, MAX_LANDMARKS = 1000, 12_000, 2000
ORDERS, RIDGE, BATCH = (1, 2, 3), 0.05, 256
#: A text is known by this share of what all but a hundredth of the sample's texts, landmarks left out, have in the vocabulary.
KNOWN = 0.8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are neither an ASCII letter nor part of a longer character become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> list[np.ndarray]:
    """The codes of the n-grams of each order, repeats included; the order is in the code's highest bits."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" ", dtype=np.uint8).astype(np.int32)
    out, code = [], np.zeros(len(data) + 1, dtype=np.int32)
    for order in ORDERS:
        code = (code[:-1] << 8 | data[order - 1 :]) if order > 1 else data
        out.append(code)
    return out


@dataclass
class Model:
    """vocabulary: sorted codes of each order; landmarks: presence rows over them; weights: landmark kernels -> language scores; least_known: the least share of a known text's n-grams in the vocabulary."""

    languages: list[str]
    vocabulary: list[np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray
    least_known: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def presence(self, texts: list[str]) -> np.ndarray:
        """A 0/1 row for each text over the vocabulary, normalised to length one."""
        return self.presence_and_share(texts)[0]

    def presence_and_share(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """presence, and for each text the share of its distinct n-grams that are in the vocabulary."""
        index_of_order = _indexes(self)
        total = sum(map(len, self.vocabulary))
        rows, strange = np.zeros((len(texts), total + 1), dtype=np.float32), np.zeros(len(texts))
        for i, (row, text) in enumerate(zip(rows, texts)):
            for index, codes in zip(index_of_order, grams(text)):
                at = index[codes]
                row[at] = 1
                strange[i] += len(np.unique(codes[at == total]))
        rows = rows[:, :-1]
        held = rows.sum(axis=1, keepdims=True)
        return rows / np.sqrt(np.maximum(held, 1)), held[:, 0] / np.maximum(held[:, 0] + strange, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scores_and_known(texts)[0]

    def scores_and_known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, share = self.presence_and_share(texts)
        return (rows @ self.landmarks.T) @ self.weights, share >= self.least_known


#: The place of each n-gram in the vocabulary, of the last model used in this process alone: it is large, and built where it is used.
_LAST: dict[str, list[np.ndarray]] = {}


def _indexes(model: Model) -> list[np.ndarray]:
    if model.key not in _LAST:
        _LAST.clear()
        total, at, built = sum(map(len, model.vocabulary)), 0, []
        for order, codes in zip(ORDERS, model.vocabulary):
            index = np.full(256**order, total, dtype=np.min_scalar_type(total))
            index[codes] = np.arange(at, at + len(codes))
            built.append(index)
            at += len(codes)
        _LAST[model.key] = built
    return _LAST[model.key]


def fit(texts: list[str], labels: list[str]) -> Model:
    """texts and labels: the sample, in the order that decides which texts are landmarks."""
    languages = sorted(set(labels))
    each = max(1, min(LANDMARKS, MAX_LANDMARKS // len(languages)))
    chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:each]]
    vocabulary = [np.unique(np.concatenate([grams(texts[i])[k] for i in chosen])) for k in range(len(ORDERS))]
    model = Model(languages, vocabulary, np.zeros((0, 0)), np.zeros((0, 0)))
    model.landmarks = model.presence([texts[i] for i in chosen])
    values, vectors = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(np.float64))
    fit_values = values > 1e-6 * values.max()
    whiten = vectors[:, fit_values] / np.sqrt(values[fit_values])
    parts = [model.presence_and_share(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
    kernels = np.concatenate([rows @ model.landmarks.T for rows, _ in parts])
    others = np.delete(np.concatenate([share for _, share in parts]), chosen)
    model.least_known = KNOWN * float(np.quantile(others, 0.01)) if len(others) else 0.0  # landmarks alone tell no bound
    features = kernels @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    # A language's own texts weigh as much as all others together.
    weight = np.where(target > 0, 0.5 / (target > 0).sum(axis=0), 0.5 / np.maximum((target < 0).sum(axis=0), 1)) * len(texts)
    solved = [np.linalg.solve((features * w[:, None]).T @ features + RIDGE * len(texts) / features.shape[1] * np.eye(features.shape[1]), (features * w[:, None]).T @ t) for w, t in zip(weight.T, target.T)]
    model.weights = (whiten @ np.stack(solved, axis=1)).astype(np.float32)
    return model


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of PER_LANGUAGE documents of each language at most, by a hash of their ids and texts; of a text over MAX_CHARS an excerpt from a place that the hash tells. Texts without a letter are left out; rows that repeat an id and a text are one document.

    Of more than MAX_LANGUAGES languages those with the most documents are taken, ties by name, and of each so many documents that all are MAX_TEXTS at most.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    # The least hashes of a frequent language lie below a bound that its count tells, so few of its rows are ranked.
    counted = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("at").alias("apart")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counted:
        return []
    each = min(PER_LANGUAGE, MAX_TEXTS // len(counted))
    bounds = docs.sparkSession.createDataFrame([(r.lang, (2.0 * each + 20) * (1 << 40) / r.apart) for r in counted], "lang string, bound double")
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    few = hashed.join(F.broadcast(bounds), "lang").filter("at <= bound").dropDuplicates(["lang", "at", "doc_id"])
    picked = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    start = F.pmod(F.col("at"), F.greatest(F.lit(1), F.length("text") - MAX_CHARS + 1)).cast("int") + 1
    rows = picked.select("lang", "place", F.substring("text", start, F.lit(MAX_CHARS)).alias("text")).orderBy("lang", "place").collect()
    return [(r.text, r.lang) for r in rows if _LETTER.search(r.text)]


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, known) and the kept columns for each row of docs; learn_from: condition on the rows of docs that may be learned from.

    score is the ridge regression's output of the predicted language, mapped from [-1, 1] to
    [0, 1]; ties go to the first language by name. known: whether enough of the text's distinct
    n-grams are in the landmarks, by a bound from the sample (none if all of it are landmarks). A null text, one without any letter, and every
    text if there is no labelled row at all get `und`, score 0 and not known. Repeated rows are predicted
    each; an empty table gives an empty result; other columns are not read. Texts are read
    whole; columns to keep that are named as the result's own are an error. The sample that is learned from is bounded by PER_LANGUAGE, MAX_CHARS, MAX_LANGUAGES and MAX_TEXTS.
    """
    refuse_clash(keep, ("doc_id", "lang_pred", "score", "known"))
    named = docs if learn_from is None else docs.filter(learn_from)
    sample = training_sample(named.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    model = fit([t for t, _ in sample], [x for _, x in sample]) if sample else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, values, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        able = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if shipped.value else []
        for a in range(0, len(able), BATCH):
            part = able[a : a + BATCH]
            scores, enough = shipped.value.scores_and_known([texts[i] for i in part])
            for i, row, best, holds in zip(part, scores, scores.argmax(axis=1), enough):
                names[i], values[i], known[i] = shipped.value.languages[best], float(min(1.0, max(0.0, (row[best] + 1) / 2))), bool(holds)
        return names, values, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, known = predict(batch.column(1).to_pylist())
            kept = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(known, pa.bool_()), *kept], [f.name for f in schema])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(fresh("text", keep)), *keep)
    added = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("known", T.BooleanType())
    schema = T.StructType([own.schema.fields[0], *added, *own.schema.fields[2:]])
    return own.mapInArrow(run, schema)
