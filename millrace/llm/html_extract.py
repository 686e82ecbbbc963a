"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into text blocks with their place in the element tree.  A linear classifier over a block's containers,
link share and length gives each label's cost; the costs are terminal capacities (source: content, sink: boilerplate),
and neighbours in page order and siblings of one parent are joined by smoothness edges, strong ones where both are the
same kind of element.  A maximum flow gives the cheapest labelling: blocks on the source side are the main text.  Where a
container says plainly what a block is (an article, a menu), its cost outweighs all edges; doubtful blocks (short ones
outside an article, paragraphs with a suspicious class, boxes whose name has a listed word beside a subject) go with
their neighbours.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base

#: Elements whose text is never shown as text.
RAW = frozenset("script style noscript template title textarea iframe svg annotation-xml annotation object".split())
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag up to its end; quoted values may hold a >.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Tags whose quotes never close, after which a page's tags end at the next > whatever their quotes.
OPEN_QUOTES = 50
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input math maction menclose merror mfrac mglyph mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that mark boilerplate or content.
BAD_TAGS = frozenset("nav footer aside form menu dialog button select option".split())
#: Elements of running text: a bad word as a part of their class ("share-price") is a weak sign only.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li td th dt dd tr table figure figcaption fieldset caption".split())
BAD_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation navigationbar newsletter notice notification overlay pagination popup promo promoted promotion reader-comments related replies reply search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget complementary replylist responses".split()
)
#: Of these, the ones that also name subjects: as a part of a name ("share-price", "related-work") they say little alone.
SUBJECTS = frozenset("ad ads banner comment comments complementary form header menu modal navigation notice notification overlay promotion related replies reply responses search share sharing social sponsor subscription toolbar widget".split())
#: Parts of names that say where or how a box stands, not what it is about, and words that are boilerplate beside one.
PLACES = frozenset("area bar block bottom box btn button buttons col column container content count footer global group header icon icons inner item items left link links list main media outer page panel post posts reader right row section site slot small sticky text top unit user wrap wrapper".split())
#: Names of outer boxes without a listed word.
OUTER = frozenset("colophon foot leftcol masthead rail rightcol sidecol skyscraper topbar".split())
#: A sentence: its end, in a block of at least SENTENCE characters.
ENDS, SENTENCE = re.compile(r"[.!?:;](?=[\s\"'\u201d)\]]|$)|[\u3002\uff01\uff1f]"), 40
GOOD_TAGS = frozenset(("article", "main"))
#: Weights of the classifier, in units of the flow (whole numbers keep the flow exact).
IN_GOOD, IN_BAD, WEAK, IN_HEADER, LINKS, OUTSIDE, LENGTH = 900, -2400, -400, -700, -500, -350, 60
#: A block without a sentence in a box whose name is doubtful.
UNSAID = -900
#: Edges between neighbours and siblings: the same kind of element under one parent, another kind, another parent.
SAME, OTHER, APART, SIBLING = 300, 60, 30, 90
CLOSES_P = frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure fieldset".split())


def named(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role (lower case) names boilerplate, and whether it may.

    A whole name of the list does.  A compound does if one of its parts never names a subject, or if its parts are all
    listed words, places and numbers ("share-buttons", "ad-3"); else a listed part only makes it doubtful.
    """
    names = value.split()
    if not BAD_WORDS.isdisjoint(names) or not OUTER.isdisjoint(names):
        return True, True
    weak = False
    for name in names:
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        listed = [x for x in parts if x in BAD_WORDS or x in OUTER]
        if listed and (not SUBJECTS.issuperset(listed) or all(x in BAD_WORDS or x in PLACES or x.isdigit() for x in parts)):
            return True, True
        weak = weak or bool(listed)
    return False, weak


class Element:
    __slots__ = ("tag", "bad", "weak", "doubtful", "good", "header", "parent", "last")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.last = tag, parent, -1
        bad, weak = tag in BAD_TAGS, False
        if attributes and not bad:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                value, key = (a or b or c).lower(), key.lower()
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    bad = True
                elif tag not in ("body", "html", "article", "main"):
                    surely, maybe = named(value)
                    if tag in TEXT_TAGS:  # a whole word only
                        surely = not BAD_WORDS.isdisjoint(value.split())
                    bad, weak = bad or surely, weak or maybe
        self.bad = bad or bool(parent and parent.bad)
        self.weak = weak or bool(parent and parent.weak)
        self.doubtful = weak and tag not in TEXT_TAGS or bool(parent and parent.doubtful)
        self.good = tag in GOOD_TAGS or bool(parent and parent.good)
        self.header = tag == "header" or bool(parent and parent.header)


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks in page order.  Unclosed elements end with their parent."""
    out: list[Block] = []
    here = Element("body", "", None)
    parts: list[str] = []
    opened: dict[str, int] = {}  # open elements by tag: an end tag without one is passed over at once
    linked = depth = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block(text, here, min(linked, len(text))))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if depth:
            linked += len(piece)

    low: str | None = None  # the page in lower case, where a raw element needs it
    at, fails = 0, 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        m = TAG.match(page, begin + 1)
        if m is None:
            close = {"!--": "-->", "![C": "]]>"}.get(page[begin + 1 : begin + 4], ">" if page[begin + 1 : begin + 2] in ("!", "?") else "")
            if not close:  # a lone <
                add(page[at : begin + 1])
                at = begin + 1
                continue
            add(page[at:begin])
            end = page.find(close, begin + (4 if close == "-->" else 2))
            if end < 0:
                break
            at = end + len(close)
            continue
        add(page[at:begin])
        rest = REST.match(page, m.end()) if fails < OPEN_QUOTES else None
        if rest is None:
            fails += 1
            end = page.find(">", m.end()) + 1
            if not end:  # a tag that the end of the page cuts
                break
        else:
            end = rest.end()
        at, tag = end, m[2].lower()
        if tag in RAW:
            if not m[1]:
                low = low if low is not None else page.lower()
                low = low if len(low) == len(page) else page  # lower case that changes places
                close = low.find(f"</{tag}", at)
                end = page.find(">", close) + 1 if close >= 0 else 0
                if not end:
                    break
                at = end
            if tag != "title":
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                depth = 0 if m[1] else 1
            continue
        flush()
        if m[1]:
            e = here if opened.get(tag) else None
            while e is not None and e.parent is not None and e.tag != tag:
                opened[e.tag] -= 1
                e = e.parent
            if e is not None and e.parent is not None:
                opened[tag] -= 1
                here, depth = e.parent, 0
        elif tag not in VOID:
            if tag in CLOSES_P and here.tag == "p" or tag == here.tag and tag in ("li", "td", "tr", "th", "option", "dt", "dd"):
                opened[here.tag] -= 1
                here = here.parent
            here = Element(tag, page[m.end() : end - 1], here)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def score(b: Block, has_good: bool) -> int:
    """Above 0: content is the cheaper label."""
    e, n = b.element, len(b.text)
    s = min(LENGTH * int(math.log2(n + 1)), (6 if has_good else 9) * LENGTH) + (LINKS if b.linked * 2 > n else 0)
    if e.bad:
        return s + IN_BAD
    if e.weak:
        s += WEAK
    if e.doubtful and (b.linked * 2 > n or n < SENTENCE or not ENDS.search(b.text)):
        s += UNSAID
    if e.header and not (e.good and e.tag == "h1"):
        s += IN_HEADER * (1 if has_good and not e.good else 2)
    if e.good:
        return s + IN_GOOD
    return s + (2 * OUTSIDE if has_good else OUTSIDE // 2)


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut (the larger such side: ties are content).

    A node's score is its capacity from the source (above 0) or to the sink (below).  A node whose score outweighs its
    edges is on that side whatever the others do: it is taken out, and its edges are added to its neighbours' scores,
    again and again.  Augmenting paths of least length, level by level, cut what is left.
    """
    n, score = len(scores), list(scores)
    to: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j:
            to[i][j] = to[i].get(j, 0) + c
            to[j][i] = to[j].get(i, 0) + c
    pull = [sum(t.values()) for t in to]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or -pull[i] <= score[i] < pull[i]:
            continue
        side[i] = score[i] >= pull[i]
        for j, c in to[i].items():
            del to[j][i]
            pull[j] -= c
            score[j] += c if side[i] else -c
            queue.append(j)
        to[i] = {}
    excess, lack = [max(0, s) for s in score], [max(0, -s) for s in score]
    left = [i for i in range(n) if side[i] is None]
    while True:
        level = {i: 0 for i in left if excess[i]}
        queue, met = deque(level), False
        while queue:
            i = queue.popleft()
            met = met or bool(lack[i])
            for j, c in to[i].items():
                if c and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            break
        untried = {i: list(to[i]) for i in level}
        for start in [i for i in left if excess[i]]:
            path = [start]
            while path and excess[start]:
                i = path[-1]
                if lack[i]:
                    flow = min(excess[start], lack[i], *(to[a][b] for a, b in zip(path, path[1:])))
                    excess[start] -= flow
                    lack[i] -= flow
                    for a, b in zip(path, path[1:]):
                        to[a][b] -= flow
                        to[b][a] += flow
                    path = [start]
                    continue
                while untried[i] and not (to[i][untried[i][-1]] and level.get(untried[i][-1]) == level[i] + 1):
                    untried[i].pop()
                if untried[i]:
                    path.append(untried[i][-1])
                else:
                    path.pop()
                    if path:
                        untried[path[-1]].pop()
    # what reaches the sink in the residual graph is on its side; the rest is the larger source side
    sink = {i for i in left if lack[i]}
    queue = deque(sink)
    while queue:
        j = queue.popleft()
        for i in to[j]:
            if i not in sink and to[i].get(j):
                sink.add(i)
                queue.append(i)
    return [i not in sink if side[i] is None else side[i] for i in range(n)]


def main_text(page: str | None) -> str:
    """The content blocks joined by newlines; empty for a null, empty or text-free page."""
    found = blocks(page or "")
    if not found:
        return ""
    has_good = any(b.element.good for b in found)
    edges = []
    for i, b in enumerate(found):
        if i:
            x, y = found[i - 1].element, b.element
            near = APART if x.parent is not y.parent else SAME if x.tag == y.tag and x.bad == y.bad else OTHER
            edges.append((i - 1, i, near))
        parent = b.element.parent
        if parent is not None:
            if parent.last >= 0:
                edges.append((parent.last, i, SIBLING if found[parent.last].element.tag == b.element.tag else SIBLING // 3))
            parent.last = i
    keep = minimum_cut([score(b, has_good) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html; others are ignored); each page by itself.

    A null, empty or text-free html gives an empty text.  Repeated rows are read alike; on ties blocks are content.  A very
    long page costs in proportion to its length; an empty table gives no rows.
    """

    @base.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base.small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(base.table(spark, sf_dir, "pages"))
