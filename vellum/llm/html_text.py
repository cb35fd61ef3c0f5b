"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels a block by its share of
linked characters, its length and its stop-word density; in a language without a stop-word
list, sentences take the place of the density. The landmark that a block stands in (tags,
roles, class names) is a vote: menus, footers and the like are boilerplate whatever they say,
a class name only if all of it says so and there is other text on the page. Short blocks stay
undecided. The second pass gives every undecided block the label of its nearest decided
neighbours within the same landmark: theirs if they agree, otherwise that of the nearer one,
and inside an article that of the text.

Reading a page takes time in proportion to its length, broken markup included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of some European languages, lower-case; fixed values.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this have from or had by but not what all were we when your can there an which their".split(),
    "fr": "le la les de des du un une et à est en que qui dans pour sur au avec ce il elle ne pas par plus se son sa ses aux ou nous vous mais".split(),
    "de": "der die das und in zu den von mit ist des im für auf nicht ein eine dem sich auch als an es er sie bei aus wie wird sind war oder".split(),
    "es": "el la los las de y en que un una es por con para se no su al lo como más del a o este pero sus le ha me si sin sobre entre".split(),
}
#: Tags whose content is never text.
DROPPED = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas audio video head title select textarea datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that a new block of any kind ends, as their end tags are optional.
IMPLIED = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that mark boilerplate, as whole parts between separators; fixed values.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead toolbar topbar share sharing social comment comments disqus respond replies related recommended recommendations newsletter subscribe subscription signup login widget pagination pager skip copyright legal".split()
)
#: Of these, the ones in which an article of its own is no main text either.
SHUT = frozenset("aside footer sidebar comment comments disqus respond replies related recommended recommendations popup modal".split())
#: Parts beside which a name of SHUT may stand around the article itself, so that it is a vote like the others.
AROUND = frozenset("content page main wrapper container layout".split())
#: Parts of a class name that say nothing about what it holds; fixed values.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button cell col column container content entry foot footer form head header holder icon id inner item items layer left line link links list main module outer panel position post posts region right row section site slot small side text title top unit view wrap wrapper zone".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_MAX = 70, 200, 0.15, 0.25, 0.33
#: A page of so many letters whose words are stop words of no list by this share is in a language without a list.
LEAST_LETTERS, LEAST_DENSITY = 150, 0.1
#: Words of a sentence on average in prose.
SENTENCE = (5, 80)

_OPEN = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
#: To the end of a tag; a quote opens a value after an equals sign only.
_QUOTED_END = re.compile(r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"""[.!?…؟।]+["'”’»)\]]*(?=\s|$)|[。！？]""")
#: Scripts that are written without spaces; two characters count as a word.
_WIDE = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_CLOSERS: dict[str, re.Pattern[str]] = {t: re.compile(rf"</{t}\b", re.IGNORECASE) for t in DROPPED}
_STOPS = {lang: frozenset(words) for lang, words in STOP_WORDS.items()}


@dataclass(frozen=True)
class Landmark:
    """mark: 'bad', 'shut' (bad, with its articles) or 'marked' (bad by its class alone), 'doubt' (a class that may mean it), 'main', or ''; inside: within an article."""

    number: int = 0
    mark: str = ""
    inside: bool = False


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    landmark: Landmark = Landmark()
    text: str = ""
    label: str = ""


def _class_mark(value: str) -> str:
    """The strongest vote of the names in a class or id."""
    votes = set()
    for name in value.split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts & MARKED:
            votes.add("doubt" if any(p not in MARKED and p not in NEUTRAL and len(p) > 2 for p in parts) else "shut" if parts & SHUT and not parts & AROUND else "marked")
    return next((v for v in ("shut", "marked", "doubt") if v in votes), "")


def _marks(tag: str, attributes: str, in_main: bool) -> str:
    """The mark of a landmark that the tag opens, or ''."""
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return "shut" if tag in SHUT else "marked" if tag == "form" else "bad"
    found = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return "bad"
            if name == "role" and value.lower() in ROLES:
                return "bad"
            if name == "role" and value.lower() in ("main", "article"):
                found = "main"
            if name in ("class", "id") and tag not in ("body", "html", "main") and found != "main":
                vote = _class_mark(value)
                if vote == "shut" or (vote == "marked" and tag != "article"):
                    return vote
                found = found or (vote if tag != "article" else "")
    return "main" if tag in ("article", "main") else found


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, attributes or text, end) of each piece of markup and text in order; kind: 'text', 'open' or 'close'.

    A caller that skips ahead sends the place to go on from. Every search that fails for the
    rest of the page is not repeated.
    """
    at, size, quoted, sections = 0, len(page), True, True
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:], size
            return
        if start > at:
            yield "text", "", page[at:start], start
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if sections and page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            if end >= 0:
                yield "text", "", page[start + 9 : end], end + 3
                at = end + 3
                continue
            sections = False
        name = _OPEN.match(page, start)
        if not name and after not in ("!", "?", "/"):
            yield "text", "", "<", start + 1
            at = start + 1
            continue
        end = -1
        if name and quoted:
            m = _QUOTED_END.match(page, name.end())
            end, quoted = (m.end(), True) if m else (-1, False)  # a quote that never ends: from here on quotes count for nothing
        if end < 0:
            end = page.find(">", start) + 1
        if end <= 0:
            return  # a tag that never ends
        at = end
        if name:
            went = yield "close" if after == "/" else "open", name[1].lower(), page[name.end() : end - 1], end
            if went is not None:
                at = went
                yield "text", "", "", at


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with its landmark; never fails on broken markup."""
    found: list[Block] = []
    block = Block()
    stack: list[tuple[str, Landmark, bool]] = []  # open tag, the landmark around it, whether it is a link
    block_at: list[int] = []  # places in the stack of the open block tags
    open_blocks: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # open inline tags, by the block they stand in
    landmark, links, count = Landmark(), 0, 0
    endless: set[str] = set()

    def cut() -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            block.landmark = landmark
            found.append(block)
        block = Block()

    def pop(to: int) -> None:
        nonlocal landmark, links
        while len(stack) > to:
            tag, landmark, link = stack.pop()
            links -= link
            if block_at and block_at[-1] == len(stack):
                block_at.pop()
                inline.pop()
                open_blocks[tag] -= 1
            else:
                inline[-1][tag] -= 1

    def close(tag: str) -> None:
        if tag in BLOCKS:
            if tag == "p" and not open_blocks["p"]:
                cut()
            if open_blocks[tag]:
                cut()
                pop(next(i for i in reversed(block_at) if stack[i][0] == tag))
        elif inline[-1][tag]:  # an inline end tag closes nothing outside its block
            if tag in BOILERPLATE:
                cut()
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))

    pieces = _tokens(page)
    for kind, tag, value, end in pieces:
        if kind == "text":
            if value:
                block.parts.append(html.unescape(value) if "&" in value else value)
                if links:
                    block.linked += len("".join(block.parts[-1].split()))
            continue
        if kind == "close":
            close(tag)
            continue
        if tag in DROPPED and not value.endswith("/"):
            closer = None if tag in endless else _CLOSERS[tag].search(page, end)
            if not closer:
                endless.add(tag)
                if tag in ("head", "title"):
                    continue
            stop = page.find(">", closer.end()) + 1 if closer else 0
            block.parts.append(" ")
            pieces.send(stop or len(page))
            continue
        if tag == "br" or tag == "wbr":
            block.parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                cut()
            continue
        if tag in BLOCKS or tag == "button":
            cut()
            # An open paragraph or item ends here; inline tags left open inside it end with it.
            for i in reversed(block_at):
                if stack[i][0] in IMPLIED and (stack[i][0] == "p" or stack[i][0] == tag):
                    pop(i)
                    break
                if stack[i][0] not in IMPLIED:
                    break
        link = tag == "a"
        mark = _marks(tag, value, landmark.mark == "main" or landmark.inside)
        if tag in BLOCKS:
            block_at.append(len(stack))
            inline.append(Counter())
            open_blocks[tag] += 1
        else:
            inline[-1][tag] += 1
        stack.append((tag, landmark, link))
        links += link
        # An article inside a form, or after a menu that was never closed, is still the article.
        if mark and (landmark.mark in ("", "main", "doubt") or (landmark.mark in ("bad", "marked") and mark in ("main", "shut"))):
            if tag not in BLOCKS:
                cut()
            count += 1
            landmark = Landmark(count, mark, landmark.inside or landmark.mark == "main")
    cut()
    return found


def density(text: str) -> float:
    """The share of stop words of the language that has the most."""
    words = [w.lower() for w in _LETTERS.findall(text)]
    return max(sum(w in stops for w in words) for stops in _STOPS.values()) / len(words) if words else 0.0


def prose(text: str) -> bool:
    """Whether a text is made of whole sentences, in any language."""
    ends = len(_SENTENCE_END.findall(text))
    letters = sum(map(len, _LETTERS.findall(text)))
    wide = len(_WIDE.findall(text))
    words = len(_LETTERS.findall(_WIDE.sub(" ", text))) + wide / 2
    return ends > 0 and letters >= 0.6 * len("".join(text.split())) and SENTENCE[0] <= words / ends <= SENTENCE[1]


def by_content(block: Block, listed: bool) -> str:
    """First pass without the landmark: 'good', 'bad', or 'short' where the block alone doesn't tell. listed: whether the page's language has stop words."""
    if block.linked > LINKS_MAX * max(1, len(block.text) - block.text.count(" ")):
        return "bad"
    size = len(block.text) + len(_WIDE.findall(block.text))
    if size < LENGTH_LOW or not _LETTERS.search(block.text):
        return "short"
    share = density(block.text)
    main = block.landmark.mark == "main"
    if main or share >= STOP_HIGH or (not listed and prose(block.text)):
        return "good" if size >= LENGTH_HIGH or main or block.landmark.inside else "short"
    return "short" if share >= STOP_LOW or not block.linked else "bad"


def decide(found: list[Block]) -> None:
    """First pass: labels the blocks of a page by their content and the marks of their landmarks."""
    plain = " ".join(b.text for b in found if not b.linked)
    listed = sum(map(len, _LETTERS.findall(plain))) < LEAST_LETTERS or density(plain) >= LEAST_DENSITY
    content = [by_content(b, listed) for b in found]
    # Where nothing else on the page is text, what a class name or a form marks may be the text after all.
    other = any(c == "good" and b.landmark.mark not in ("bad", "shut", "marked") for b, c in zip(found, content))
    held: Counter[Landmark] = Counter()
    for b, c in zip(found, content):
        held[b.landmark] += len(b.text) if c == "good" else 0
    for b, c in zip(found, content):
        open_again = b.landmark.mark == "marked" and not other and held[b.landmark] >= LENGTH_HIGH
        b.label = "bad" if b.landmark.mark in ("bad", "shut") or (b.landmark.mark == "marked" and not open_again) else c


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text. Undecided blocks without a decided neighbour in their landmark count as text inside an article."""
    found = blocks_of(page)
    decide(found)
    decided = any(b.label != "short" for b in found)
    has_main = any(b.landmark.mark == "main" for b in found)
    before: list[int | None] = []
    last: dict[Landmark, int] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.landmark))
        if b.label != "short":
            last[b.landmark] = i
    after: list[int | None] = [None] * len(found)
    last = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = last.get(found[i].landmark)
        if found[i].label != "short":
            last[found[i].landmark] = i
    kept = []
    for i, b in enumerate(found):
        label = b.label
        if label == "short":
            near = [j for j in (before[i], after[i]) if j is not None]
            if near:
                label = found[min(near, key=lambda j: (abs(j - i), found[j].label == "good"))].label
                if b.landmark.mark == "main" and (len(near) == 1 or "good" in (found[j].label for j in near)):
                    label = "good"  # inside an article a block is boilerplate only between such blocks
            elif b.landmark.mark == "main" or (not has_main and not decided):
                label = "good"
            else:
                label = "bad"
        if label == "good":
            kept.append(b.text)
    return kept


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id, the kept columns, text (blocks joined by one newline; empty if none) and n_chars for each row of pages.

    A null or empty page has an empty text. Broken markup is read as far as it goes. Repeated
    rows are read each; an empty table gives an empty result; columns not named are not read.
    Pages are read whole, one at a time.
    """
    own = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("__html"))
    fields = [f for f in own.schema.fields if f.name != "__html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(page.as_py())) if page.is_valid else "" for page in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    return own.mapInArrow(run, schema)
