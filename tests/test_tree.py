"""The element table against a recursive search over a plain stack parser."""

import random

import pytest

from vellum.sources import tree

PAGES = [
    "<r><a x='1'>one<a>two</a>three</a><b/><a/>tail</r>",
    "<p>a<p>b</p>c</p></x><q>open",
    "<!-- <p>no</p> --><p t=\"a > b\" u='&lt;'>x &amp; y<![CDATA[<p> & ]]></p><?pi <p> ?><!DOCTYPE p>",
    "<tc><p>1</p><tbl><tc><p>2</p></tc></tbl><p>3</p></tc>",
    "", "<", "<a", "text only", "<a b='unended>text</a>", "<a><b></a></b>c", "< a>x</ a >",
]


class Node:
    def __init__(self, tag, parent):
        self.tag, self.parent, self.children, self.text = tag, parent, [], ""

    def find_all(self, tag, stop=()):
        for c in self.children:
            if c.tag == tag:
                yield c
            if c.tag not in stop:
                yield from c.find_all(tag, stop)

    def said(self):
        return self.text + "".join(c.said() for c in self.children)


def parsed(rows):
    """Nodes by their number, from the parents alone."""
    nodes = {0: Node("", None)}
    for pre, _, _, _, parent, tag, _, text, _ in rows:
        nodes[pre] = Node(tag, nodes[parent])
        nodes[pre].text = text or ""
        nodes[parent].children.append(nodes[pre])
    return nodes


def made_up(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<c/>", "t", "<!-- <a> -->", "<d e='>'>", "</d>"]) for _ in range(60))


@pytest.mark.parametrize("page", [*PAGES, *map(made_up, range(30))])
def test_intervals_say_what_the_parents_say(page):
    rows = tree.nodes_of(page)
    nodes = parsed(rows)
    above = lambda n: [] if n.parent is None else [n.parent, *above(n.parent)]
    for pre, last, post, depth, *_ in rows:
        below = {r[0] for r in rows if pre < r[0] <= last}
        assert below == {r[0] for r in rows if nodes[pre] in above(nodes[r[0]])} and depth == len(above(nodes[pre]))
        assert all(r[2] < post for r in rows if r[0] in below)
    assert sorted(r[2] for r in rows) == list(range(1, len(rows) + 1))


def test_what_is_parsed():
    kinds = lambda page: [(r[5], r[7]) for r in tree.nodes_of(page)]
    assert kinds(PAGES[0]) == [("r", None), ("a", None), ("#text", "one"), ("a", None), ("#text", "two"), ("#text", "three"), ("b", None), ("a", None), ("#text", "tail")]
    assert kinds(PAGES[2]) == [("p", None), ("#text", "x &amp; y"), ("#text", "<p> & "), ("#text", " ?>")]
    assert tree.nodes_of(PAGES[2])[0][6] == [("t", "a > b"), ("u", "&lt;")]
    assert kinds("<P>a<BR>b</p>") == [("P", None), ("#text", "a"), ("BR", None), ("#text", "b")]
    assert [(r[5], r[1]) for r in tree.nodes_of("<P>a<BR>b</p>c", frozenset(["br"]), True)] == [("p", 4), ("#text", 2), ("br", 3), ("#text", 4), ("#text", 5)]


def test_searches_equal_a_recursive_one(spark):
    pages = [*PAGES, *map(made_up, range(30))]
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(99, None)], "doc_id long, text string")
    table = tree.element_tree(docs).cache()
    tops = table.filter("tag in ('a', 'tc', 'p')")
    found = lambda frame: sorted((r.doc_id, r.top, r.pre) for r in frame.collect())
    want, first, direct, texts = {s: [] for s in ((), ("b", "tbl"))}, [], [], {}
    for i, p in enumerate(pages):
        nodes = parsed(tree.nodes_of(p))
        number = {id(n): k for k, n in nodes.items()}
        for pre, node in nodes.items():
            if node.tag in ("a", "tc", "p"):
                for stop, rows in want.items():
                    rows += [(i, pre, number[id(n)]) for n in node.find_all("a", stop)]
                first += [(i, pre, number[id(n)]) for n in list(node.find_all("a"))[:1]]
                direct += [(i, pre, number[id(n)]) for n in node.children if n.tag == "a"]
                texts[i, pre] = " ".join(node.said().replace("&amp;", "&").split())
    for stop, rows in want.items():
        assert found(tree.descendants(table, tops, "a", stop)) == sorted(rows)
    assert found(tree.first_descendants(table, tops, "a")) == sorted(first)
    assert found(tree.children(table, tops, "a")) == sorted(direct)
    assert found(tree.children(table, tops, "a", first=True)) == sorted({(i, t): (i, t, n) for i, t, n in sorted(direct, reverse=True)}.values())
    assert {(r.doc_id, r.top): r.text for r in tree.inner_texts(table, tops).collect()} == texts


def test_nested_paragraphs_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    table = tree.element_tree(pages, id_col="page_id", text_col="html", html=True)
    got = {}
    for r in table.groupBy("doc_id", "tag").count().collect():
        got[r.doc_id, r.tag] = r["count"]
    want = {}
    for r in pages.collect():
        for row in tree.nodes_of(r.html or "", frozenset(tree.HTML_VOID), True):
            want[r.page_id, row[5]] = want.get((r.page_id, row[5]), 0) + 1
    assert got == want and len(got) > 100
