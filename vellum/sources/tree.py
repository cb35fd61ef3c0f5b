"""Markup as a table of elements: a node's interval of numbers holds its descendants', so searches are joins.

Nodes are numbered in the order in which they open; `last` is the number of a node's last descendant, so d is below e
if e.pre < d.pre <= e.last. A closing tag ends the nearest open element of its name and all that is open inside
it; one without any is passed over, and what is open at the end ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.text import decode_entities

#: Comments, character data, instructions, tags (a bracket inside quotes doesn't end one; the last may be cut off) and text.
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[?!][^>]*>?|<(?P<tag>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|["'].*\Z|\Z)|(?P<text>[^<]+)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
TEXT = "#text"
NODES = "pre int, last int, post int, depth int, parent int, tag string, attributes map<string,string>, text string, raw boolean"
_ARROW = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_()]


def nodes_of(source: str, void: frozenset[str] = frozenset(), fold: bool = False) -> list[list]:
    """The rows of NODES of one text, in the order in which they open. void: tags without an end; fold: names in lower case."""
    rows: list[list] = []
    open_: list[list] = []
    closed = 0

    def opened(tag: str, attributes: list, text: str | None, raw: bool) -> list:
        row = [len(rows) + 1, len(rows) + 1, 0, len(open_) + 1, open_[-1][0] if open_ else 0, tag, attributes, text, raw]
        rows.append(row)
        return row

    def close(row: list) -> None:
        nonlocal closed
        closed += 1
        row[1], row[2] = len(rows), closed

    for token in _TOKEN.finditer(source):
        name, text = token.lastgroup, token[0]
        if name in ("text", "data"):
            if token[name]:
                close(opened(TEXT, [], token[name], name == "data"))
        elif name == "tag":
            inner = token["tag"]
            if inner.startswith("/"):
                ends = inner[1:].strip()
                ends = ends.lower() if fold else ends
                if any(row[5] == ends for row in open_):
                    while True:
                        row = open_.pop()
                        close(row)
                        if row[5] == ends:
                            break
                continue
            alone = inner.endswith("/")
            parts = (inner[:-1] if alone else inner).split(None, 1)
            tag = parts[0] if parts and not inner[0].isspace() else ""
            tag = tag.lower() if fold else tag
            found = {k: a or b for k, a, b in _ATTRIBUTE.findall(parts[1])} if len(parts) > 1 else {}
            row = opened(tag, list(found.items()), None, False)
            if alone or tag in void:
                close(row)
            else:
                open_.append(row)
    while open_:
        close(open_.pop())
    return rows


#: Elements of web pages that have no end tag; fixed values.
HTML_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def element_tree(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", html: bool = False) -> DataFrame:
    """(doc_id, pre, last, post, depth, parent, tag, attributes, text): a row for each element and text node of each text; parent 0: none.

    Text nodes have the tag #text. html: names in lower case, and elements that never end. A null text has no nodes; rows that repeat an id must be told apart by the caller.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    void = frozenset(HTML_VOID) if html else frozenset()
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = nodes_of(batch.column(1)[i].as_py() or "", void, html)
                # A long page is many nodes, which go on in parts.
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    ids = batch.column(0).slice(i, 1).take(pa.array([0] * len(part)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*part), _ARROW))], names)

    names = ["doc_id", *(field.split()[0] for field in NODES.replace("map<string,string>", "map").split(", "))]
    nodes = own.mapInArrow(run, f"doc_id {kind}, {NODES}")
    values = F.transform_values("attributes", lambda _, v: decode_entities(v))
    return nodes.withColumn("text", F.when(F.col("raw"), F.col("text")).otherwise(decode_entities(F.col("text")))).withColumn("attributes", values).drop("raw")


def _inside(of: DataFrame, below: DataFrame) -> DataFrame:
    """Pairs of nodes: of (doc_id, top, top_last) and the nodes below it."""
    return of.join(below, (of["doc_id"] == below["doc_id"]) & (below["pre"] > of["top"]) & (below["pre"] <= of["top_last"])).drop(of["doc_id"])


def _tops(of: DataFrame) -> DataFrame:
    return of.select("doc_id", F.col("pre").alias("top"), F.col("last").alias("top_last"))


def descendants(tree: DataFrame, of: DataFrame, tag: str, stop: Sequence[str] = ()) -> DataFrame:
    """(top, and the columns of tree): the nodes of a tag below each node of `of`; none that stands inside an element of the tags `stop` below it."""
    hits = _inside(_tops(of), tree.filter(F.col("tag") == tag))
    if stop:
        walls = tree.filter(F.col("tag").isin(*stop)).select(F.col("doc_id").alias("w_doc"), F.col("pre").alias("w_pre"), F.col("last").alias("w_last"))
        hits = hits.join(walls, (F.col("doc_id") == F.col("w_doc")) & (F.col("w_pre") > F.col("top")) & (F.col("w_pre") < F.col("pre")) & (F.col("pre") <= F.col("w_last")), "left_anti")
    return hits.select("top", *tree.columns)


def first_descendants(tree: DataFrame, of: DataFrame, tag: str) -> DataFrame:
    """The first node of a tag below each node of `of`, if any."""
    place = F.row_number().over(Window.partitionBy("doc_id", "top").orderBy("pre"))
    return descendants(tree, of, tag).withColumn("__place", place).filter("__place = 1").drop("__place")


def children(tree: DataFrame, of: DataFrame, tag: str, first: bool = False) -> DataFrame:
    """(top, and the columns of tree): the nodes of a tag directly below each node of `of`; first: the first of them alone."""
    found = tree.filter(F.col("tag") == tag).withColumn("top", F.col("parent")).join(of.select("doc_id", F.col("pre").alias("top")), ["doc_id", "top"])
    if first:
        place = F.row_number().over(Window.partitionBy("doc_id", "top").orderBy("pre"))
        found = found.withColumn("__place", place).filter("__place = 1").drop("__place")
    return found.select("top", *tree.columns)


def inner_texts(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, top, text): all text below each node of `of`, in order, white space as one space."""
    parts = _inside(_tops(of), tree.filter(F.col("tag") == TEXT).select("doc_id", "pre", "text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "")
    texts = parts.groupBy("doc_id", "top").agg(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("text"))
    return _tops(of).drop("top_last").join(texts, ["doc_id", "top"], "left").select("doc_id", "top", F.coalesce("text", F.lit("")).alias("text"))
