"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbols. Each pass
finds every sequence's lowest-rank pair and merges all its occurrences, in all sequences at
once, until no pair has a rank; what is left of a sequence is its token count. A merge only
makes pairs of higher rank than its own, so this equals merging one pair at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and numbers (hex ranges) that are newer than Unicode 16.0, the version of the tokenizer library; fixed values.
NEWER_LETTERS = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
NEWER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _ranges(spec: str) -> str:
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in spec.split())


_LETTER, _NUMBER = rf"[\p{{L}}--[{_ranges(NEWER_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(NEWER_NUMBERS)}]]"
#: The pre-tokenizer's pattern of byte-level BPE vocabularies; a fixed value. Texts without a newer character take the plain form.
_FORM = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?[^\sLETTERNUMBER]+|\s+(?!\S)|\s+"
PATTERN = _FORM.replace("LETTER", r"\p{L}").replace("NUMBER", r"\p{N}")
_EXACT = regex.compile("(?V1)" + _FORM.replace("LETTER", _LETTER).replace("NUMBER", _NUMBER))
_PLAIN = regex.compile(PATTERN)
_NEWER = regex.compile(f"[{_ranges(NEWER_LETTERS)}{_ranges(NEWER_NUMBERS)}]")
#: Pre-tokens whose counts a task remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Characters of text that are split at a time.
SLICE_CHARS = 1_000_000
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level BPE file as arrays: sorted pair keys with their rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.base = len(vocab)
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that each byte string ends with."""
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        counts, name = np.zeros(len(tokens), dtype=np.int64), np.flatnonzero(lengths)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        lengths = lengths[name]
        while len(name):
            starts = np.cumsum(lengths) - lengths
            ends = starts + lengths - 1
            keys = symbols * self.base
            keys[:-1] += symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            ranks = np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)
            ranks[ends] = NO_RANK  # the last symbol of a sequence has no right neighbour
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != NO_RANK
            counts[name[~live]] = lengths[~live]
            hit = ranks == np.repeat(np.where(live, lowest, -1), lengths)
            where = np.flatnonzero(hit)
            # Of overlapping occurrences (a a a) every other one counts, from the left.
            first = np.ones(len(where), dtype=bool)
            first[1:] = np.diff(where) > 1
            run = np.flatnonzero(first)[np.cumsum(first) - 1] if len(where) else where
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.merged[at[where]]
            keep = np.repeat(live, lengths)
            keep[where + 1] = False
            lengths = np.add.reduceat(keep, starts, dtype=np.int64)[live]
            name, symbols = name[live], symbols[keep]
        return counts


def _split(text: str) -> list[str]:
    """The pre-tokens of a text; only one with characters beyond Latin-1 can hold a newer letter or number."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _NEWER.search(text):
            return _EXACT.findall(text)
    return _PLAIN.findall(text)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_texts(texts: list[str], table: MergeTable, known: dict[str, int]) -> list[int]:
    """Tokens of each text. Special strings count as one token each. known: counts of pre-tokens, kept between calls."""
    special = regex.compile("|".join(map(regex.escape, table.specials)) or r"(?!)")
    out: list[int] = []
    for part in _slices(texts):
        cut = [special.split(t) if any(s in t for s in table.specials) else [t] for t in part]
        found = [[w for piece in pieces for w in _split(piece)] for pieces in cut]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for ws in found for w in ws if w not in known})
        known.update(zip(fresh, table.count([w.encode() for w in fresh]).tolist()))
        out += [sum(map(known.__getitem__, ws)) + len(pieces) - 1 for ws, pieces in zip(found, cut)]
    return out


def count_tokens(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, without begin, end or padding.

    vocab_path: a byte-level BPE .json; the driver reads it and ships its merges, whose
    number the file fixes. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are
    counted each; an empty table gives an empty result; other columns are not read. Texts of
    any length are split whole, a slice of the rows at a time.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(MergeTable(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = pa.array(count_texts(texts.to_pylist(), shipped.value, known), pa.int64())
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, counts, pc.greater(counts, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
