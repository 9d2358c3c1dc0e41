"""Main text of web pages by maximum-scoring subsequence: a page is a row of words and tags; words score by where they
stand (mostly positive), tags negative, and one linear scan finds the contiguous region with the highest sum.

The weights come from labelled pages: pages that mark their own article (an article or main element, or the articleBody
property) tell which of their words and tags are content. The marks themselves are not features, so that the weights
serve pages without them. Elements and names that speak of menus, adverts, forms, comments and the like are features too,
with how much running text they hold, and where labelled pages say nothing, prior weights. Such an element whose own
words and tags come to no positive sum is left out of the region; only scripts, styles and the like, and HTML's comments,
are never text.

The region is then made whole. The block that holds all of its words is its container; of the container's other parts, headings,
paragraphs, lists, tables, figures and the like belong to it however short their items are, and any other block whose own words
come to a positive sum. Straight below the page's body, where menus and the like may stand too, only parts next to the region do.
A header or an aside inside a container counts by its own words.

Pages are read in one pass whose time grows with their length alone, however malformed.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: About how many labelled pages the weights are learned from.
MAX_LABELLED = 4000
#: Words and tags that each prior weight counts as.
PRIOR = 50.0
#: What stands in elements that are left out parts regions with this share of its weight alone: an advert between two
#: paragraphs should not.
OUT_SHARE = 0.25
#: Words of running text from which an element is large; and the share of the page's with which it holds most of it.
LARGE, MOST = 100, 0.5
#: Share of words in links from which an element is one of links.
LINKS = 0.5

# Elements of HTML by their part in a page, and names that pages give to parts.
SWALLOW = frozenset("script style textarea title".split())  # unclosed, they end with the page
RAW = SWALLOW | frozenset("template noscript svg math iframe object canvas select audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FRAME = frozenset("html head body meta link base article main".split())  # tell nothing, or mark the article
PLAIN = frozenset("article main body html section center hgroup dir".split())  # blocks that say no more than div
#: Blocks that a region's container holds whole, and blocks that only the page's body may hold.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary address hr hgroup".split())
TOP = frozenset(["", "html", "body"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a b br i em strong code span small sub sup u s q cite abbr mark time img kbd var samp del ins font wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
ELEMENTS = {"nav": "nav", "menu": "nav", "aside": "side", "footer": "footer", "header": "header", "form": "form", "search": "form", "fieldset": "control", "button": "control", "label": "control", "legend": "control", "datalist": "control", "dialog": "notice"}
ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "toolbar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice"}
NAMES = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay banner",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar pagination pager skip",
    "side": "sidebar side rail widget widgets",
    "footer": "footer copyright",
    "header": "masthead header",
    "share": "share sharing social related recommended recommendations tags",
    "comment": "comment comments commentlist disqus respond replies reply",
    "form": "newsletter subscribe subscription signup login search",
}
NAMES = {name: kind for kind, names in NAMES.items() for name in names.split()}
GENERIC = frozenset(
    "area bar block bottom box btn button buttons col column container content footer form global group header holder icon icons inner item items left link links list main "
    "outer page panel post posts primary region right row secondary section site slot text title top unit wrap wrapper zone article articles".split()
)
NOT = frozenset("no not has with without".split())
OWN_HEADER = frozenset("article entry post section content story".split())
#: Prior share of content of words in elements of a kind: small, large, holding most of the page.
KINDS = {
    "ad": (0.02, 0.05, 0.3), "notice": (0.02, 0.1, 0.5), "nav": (0.02, 0.05, 0.3), "side": (0.02, 0.05, 0.3), "footer": (0.02, 0.03, 0.2), "share": (0.02, 0.1, 0.5),
    "comment": (0.01, 0.01, 0.03), "form": (0.02, 0.15, 0.7), "header": (0.15, 0.3, 0.6), "control": (0.02, 0.1, 0.5), "hidden": (0.02, 0.05, 0.5), "partly": (0.55, 0.65, 0.75),
}
#: The same of words in blocks that are of no kind, and of their links; of tags.
BLOCKS = {"p": (0.9, 0.6), "blockquote": (0.9, 0.6), "pre": (0.9, 0.6), "dd": (0.7, 0.4), "dt": (0.7, 0.4), "td": (0.65, 0.25), "li": (0.6, 0.25)} | {f"h{i}": (0.95, 0.6) for i in range(1, 7)}
OTHER_BLOCK = (0.6, 0.3)
TAGS = {t: 0.97 for t in INLINE | {"p", "blockquote", "pre"} | CLOSED_BY_BLOCK} | {t: 0.97 for t in "table tbody thead tr td th caption".split()} | {t: 0.9 for t in "ul ol li dl dt dd figure figcaption".split()}
OTHER_TAG = 0.8

_SCAN = re.compile("[<>\"']")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Token:
    """A tag, or the text between two tags (n words). where: the element of a kind that it is in (-1: none); level: how the
    page marks it (2: an article, 1: main, 0: not); block: text with the same number is of one block; node: the nearest block
    element, by its number in order of the page."""

    __slots__ = ("tag", "text", "n", "link", "where", "level", "block", "node", "feature")

    def __init__(self, tag: str, text: str | None, n: int, link: bool, where: int, level: int, block: int, node: int):
        self.tag, self.text, self.n, self.link, self.where, self.level, self.block, self.node, self.feature = tag, text, n, link, where, level, block, node, ""


class Node:
    """A block element. up: the one that it is in; end: past the last one in it; level: how the page marks it."""

    __slots__ = ("tag", "up", "end", "level")

    def __init__(self, tag: str, up: int, level: int):
        self.tag, self.up, self.end, self.level = tag, up, 0, level


class Element:
    """An element of a kind. up: the one that it is in; level: how the page marks what it stands in; node: the block element that it
    is, if its tag alone speaks of its kind, else -1."""

    __slots__ = ("kind", "up", "level", "words", "links", "node")

    def __init__(self, kind: str, up: int, level: int):
        self.kind, self.up, self.level, self.words, self.links, self.node = kind, up, level, 0, 0, -1


@lru_cache(maxsize=4096)
def name_kind(value: str) -> str:
    """The kind that one class or id speaks of: a kind where all its parts do or say nothing more, "partly" where one part
    does beside others ("social-history"), else ""."""
    parts = [p.lower() for p in _PARTS.findall(value)]
    if NOT & set(parts):
        return ""
    kinds = [NAMES[p] for p in parts if p in NAMES and not (p == "header" and OWN_HEADER & set(parts))]
    if not kinds:
        return ""
    if any(p not in NAMES and p not in GENERIC for p in parts):
        return "partly"
    return "comment" if "comment" in kinds else kinds[0]


def _kind(tag: str, attrs: str) -> tuple[str, int]:
    """The kind of an element ("": none), and how it marks an article. A reader's comment never does, also where it stands in
    an article element of its own."""
    kinds, level = [ELEMENTS[tag]] if tag in ELEMENTS else [], 2 if tag == "article" else int(tag == "main")
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value, name = values[0] or values[1] or values[2], name.lower()
        if name in ("class", "id"):
            kinds += [k for k in map(name_kind, value.split()[:50]) if k]
        elif name == "role":
            kinds += [ROLES[r] for r in value.lower().split()[:5] if r in ROLES]
            level = max(level, {"main": 1, "article": 2}.get(value.lower(), 0))
        elif name == "itemprop":
            level = max(level, 2 * (value.lower() == "articlebody"))
        elif name == "hidden" or value.lower() == "true":
            kinds.append("hidden")
    if tag in ("body", "html"):
        return "", level
    whole = [k for k in kinds if k != "partly"]
    if "comment" in whole:
        return "comment", 0
    return (whole or kinds or [""])[0] if not level else "", level


def unescape(text: str) -> str:
    """html.unescape, also where a number has more digits than Python takes."""
    if "&#" in text:
        text = re.sub(r"&#[1-9][0-9]{7,};?", "�", re.sub(r"&#0+(?=[0-9])", "&#", text))
    return html.unescape(text)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """What a page is made of, in order: ("text", text, ""), ("open", tag, attributes) and ("close", tag, ""). Scripts, styles
    and the like, HTML's comments and declarations give nothing. A tag ends at > outside quotes, or before another <; an
    unclosed quote is none. What no > follows is text."""
    at, n, last = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        close = after == "/"
        name = _NAME.match(page, lt + 1 + close) if lt < last else None
        if name is None:
            if close and lt < last:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        tag = name[0].partition("<")[0].lower()
        start = at = name.start() + len(tag)
        end = -1
        while end < 0:
            m = _SCAN.search(page, at)
            if m is None:
                end = n
            elif m[0] in "<>":
                end = m.start()
            else:
                quote = page.find(m[0], m.end()) if m[0] not in unclosed else -1
                if quote < 0:
                    unclosed.add(m[0])  # there is no other one further on
                    m = re.compile("[<>]").search(page, m.end())
                    end = n if m is None else m.start()
                else:
                    at = quote + 1
        at = end + (page[end : end + 1] == ">")
        if close:
            yield "close", tag, ""
            continue
        attrs = page[start:end]
        if tag in RAW:
            if attrs.endswith("/"):
                continue
            found = _ENDS[tag].search(page, at) if tag not in unclosed else None
            if found:
                at = found.end()
            elif tag in SWALLOW:
                return
            else:
                unclosed.add(tag)
            continue
        yield "open", tag, attrs


def tokens(page: str) -> tuple[list[Token], list[Element], int]:
    """The page's tokens, its elements of a kind, and how it marks its article at best (0: not)."""
    return parse(page)[:3]


def parse(page: str) -> tuple[list[Token], list[Element], int, list[Node]]:
    """The same, and its block elements; the first stands for the page."""
    out: list[Token] = []
    elements: list[Element] = []
    nodes = [Node("", -1, 0)]
    # Tag, element of a kind, level of marks, nearest block's tag and place in the stack, whether in a link, nearest block's number.
    stack: list[tuple[str, int, int, str, int, bool, int]] = [("", -1, 0, "", 0, False, 0)]
    open_: Counter[str] = Counter()
    block = best = 0

    def drop(size: int) -> None:
        while len(stack) > size:
            gone = stack.pop()
            open_[gone[0]] -= 1
            if gone[0] in BLOCK:
                nodes[gone[6]].end = len(nodes)

    for what, tag, attrs in pieces(page):
        top = stack[-1]
        if what == "text":
            text = unescape(tag)
            n = len(text.split())
            if n:
                out.append(Token(top[3], text, n, top[5], top[1], top[2], block, top[6]))
            elif out and out[-1].text is not None and out[-1].block == block:
                out[-1].text += " "
            else:
                out.append(Token("", " ", 0, False, top[1], top[2], block, top[6]))
            continue
        if tag in BLOCK:
            block += 1
        if tag == "br":
            out.append(Token("", " ", 0, False, top[1], top[2], block, top[6]))
        if what == "close":
            if open_[tag] > 0:
                size = len(stack)
                while stack[size - 1][0] != tag:
                    size -= 1
                drop(size - 1)
        else:
            if tag in BLOCK and (top[3] in CLOSED_BY_BLOCK or top[3] in CLOSES.get(tag, ())):
                drop(top[4])  # a paragraph, heading or item that was not closed ends here
                top = stack[-1]
            kind, level = _kind(tag, attrs)
            level, where = max(level, top[2]), top[1]
            if kind == "comment":
                level = 0
            best = max(best, level)
            if kind:
                elements.append(Element(kind, where, level))
                where = len(elements) - 1
            node, holds = top[6], tag not in VOID and not attrs.endswith("/")
            if tag in BLOCK and holds:
                nodes.append(Node(tag, node, level))
                node = len(nodes) - 1
                if kind in ("header", "side") and not _kind("div", attrs)[0]:
                    elements[where].node = node
            top = (tag, where, level, tag if tag in BLOCK else top[3], len(stack) if tag in BLOCK else top[4], tag == "a" or (top[5] and tag not in BLOCK), node)
            if holds:
                stack.append(top)
                open_[tag] += 1
        if tag not in FRAME:
            out.append(Token(tag, None, 1, False, top[1], top[2], block, top[6]))
    drop(0)
    nodes[0].end = len(nodes)
    for t in out:
        if t.text is not None and t.where >= 0:
            elements[t.where].words += t.n
            elements[t.where].links += t.n if t.link else 0
    for e in reversed(elements):
        if e.up >= 0:
            elements[e.up].words += e.words
            elements[e.up].links += e.links
    running = sum(t.n for t in out if t.text is not None and not t.link)
    places = [""] * len(elements)
    for i, e in enumerate(elements):
        size = 2 if e.words - e.links >= MOST * max(1, running) else int(e.words - e.links >= LARGE)
        places[i] = f"{e.kind} {size}{' links' if e.links >= LINKS * max(1, e.words) else ''}"
    for t in out:
        if t.text is None:
            t.feature = f"t|{places[t.where] if t.where >= 0 else ''}|{t.tag if t.tag in BLOCK or t.tag in INLINE else 'other'}"
        elif t.n:
            t.feature = f"w|{places[t.where] if t.where >= 0 else ''}|{'div' if t.tag in PLAIN or not t.tag else t.tag}|{'a' if t.link else ''}"
    return out, elements, best, nodes


@lru_cache(maxsize=65536)
def prior(feature: str) -> float:
    """The share of content that a feature is taken to have where labelled pages say nothing."""
    what, place, tag, *link = feature.split("|")
    share = 1.0
    if place:
        kind, size, *links = place.split()
        share = KINDS[kind][int(size)]
        if kind == "header" and not links and tag in CLOSED_BY_BLOCK - {"p"}:
            share = 0.6
        if links:
            share = min(share, 0.05)
    if what == "t":
        return 0.2 if share < 0.5 else TAGS.get(tag, OTHER_TAG)
    own = BLOCKS.get(tag, OTHER_BLOCK)[link[0] == "a"]
    return share if share < 0.5 else own


def _weight(feature: str, share: float) -> float:
    return 2 * share - 1 if feature[0] == "w" else -0.1 - 2.9 * (1 - share)


def learn(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights from (content, other) counts of each feature: a word's is between -1 and 1 by its odds of being content, a
    tag's between -3 and -0.1, lower the more it stands outside content."""
    return {f: _weight(f, (inside + PRIOR * prior(f)) / (inside + outside + PRIOR)) for f, (inside, outside) in counts.items()}


def labelled_counts(page: str) -> dict[str, tuple[float, float]]:
    """(content, other) counts of each feature on a page that marks its article; nothing on others. What stands inside the
    article in an element of a kind of its own is not counted: the mark does not tell whether it is content."""
    found, elements, best = tokens(page)
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    if best:
        for t in found:
            inside = t.level >= best
            own = t.where >= 0 and elements[t.where].level >= best and elements[t.where].kind != "partly"
            if t.feature and not own:
                counts[t.feature][not inside] += t.n
    return {f: (a, b) for f, (a, b) in counts.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum, the first such; (0, 0) if no sum is over 0."""
    best, bounds, held, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if held <= 0:
            held, start = 0.0, i
        held += s
        if held > best:
            best, bounds = held, (start, i + 1)
    return bounds


def scored(found: list[Token], elements: list[Element], weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether it is left out: it stands in an element of a kind whose own words and tags, but
    for those of elements left out in it, come to no positive sum."""
    scores = []
    for t in found:
        w = weights.get(t.feature)
        scores.append(0.0 if not t.feature else (_weight(t.feature, prior(t.feature)) if w is None else w) * t.n)
    sums = [0.0] * len(elements)
    for t, s in zip(found, scores):
        if t.where >= 0:
            sums[t.where] += s
    out = [False] * len(elements)
    for i in range(len(elements) - 1, -1, -1):
        out[i] = sums[i] <= 0
        if not out[i] and elements[i].up >= 0:
            sums[elements[i].up] += sums[i]
    for i, e in enumerate(elements):
        out[i] = out[i] or (e.up >= 0 and out[e.up])
    left = [t.where >= 0 and out[t.where] for t in found]
    return [s * OUT_SHARE if o else s for s, o in zip(scores, left)], left


def container(found: list[Token], nodes: list[Node], words: list[int]) -> int:
    """The block that holds all of the given tokens, and is no heading, paragraph, item or the like itself."""
    at = found[words[0]].node
    for i in words:
        while not at <= found[i].node < nodes[at].end:
            at = nodes[at].up
    while nodes[at].tag in TEXTUAL:
        at = nodes[at].up
    return at


def make_whole(found: list[Token], elements: list[Element], nodes: list[Node], scores: list[float], left: list[bool], start: int, end: int) -> tuple[set[int], list[bool]]:
    """The tokens of the region from start to end and of the parts that belong to it, and which tokens are left out of it."""
    words = [i for i in range(start, end) if found[i].text is not None and found[i].n and not left[i]]
    taken = set(range(start, end))
    if not words:
        return taken, left
    home = container(found, nodes, words)
    parts_of_kind: set[int] = set()
    if nodes[home].tag not in TOP:  # headers and asides of the article's own
        own = [e.node > home and e.node < nodes[home].end and e.links < LINKS * max(1, e.words) for e in elements]
        parts_of_kind = {e.node for e, o in zip(elements, own) if o}
        gone: list[bool] = []
        for i, e in enumerate(elements):
            above = e.up >= 0 and gone[e.up]
            gone.append(above or not own[i])
        was_out = {t.where for t, o in zip(found, left) if o}
        kept_out = [i in was_out and gone[i] for i in range(len(elements))]
        left = [o and (t.where < 0 or kept_out[t.where]) for t, o in zip(found, left)]
    held = defaultdict(list)
    first = next(i for i, t in enumerate(found) if home <= t.node < nodes[home].end)
    part, last = -1, len(found)
    for i in range(first, len(found)):
        v = found[i].node
        if not home <= v < nodes[home].end:
            last = i
            break
        if v == home:
            part = -1 - found[i].block  # text that stands in the container itself
        elif part < 0 or not part <= v < nodes[part].end:
            part = v
            while nodes[part].up != home:
                part = nodes[part].up
        held[part].append(i)
    order, inside = list(held), set(words)
    hit = [any(i in inside for i in held[p]) for p in order]
    low, high = hit.index(True), len(hit) - 1 - hit[::-1].index(True)
    top, marked = nodes[home].tag in TOP, nodes[home].level > 0
    headed = next((at for at, p in enumerate(order[:high]) if p >= 0 and nodes[p].tag in HEADINGS), high)

    def belongs(place: int) -> bool:
        p = order[place]
        mine = [i for i in held[p] if found[i].text is not None and not left[i]]
        n = sum(found[i].n for i in mine)
        links = sum(found[i].n for i in mine if found[i].link)
        if not n:
            return not any(found[i].n for i in held[p] if found[i].text is not None)
        if p < 0:
            return not top and links < LINKS * n
        if nodes[p].tag in TEXTUAL:
            return marked or links < LINKS * n or place > headed  # a menu stands before the title
        if p in parts_of_kind:
            return True
        return not top and links < LINKS * n and sum(scores[i] for i in held[p]) > 0

    for step, places in ((-1, range(low - 1, -1, -1)), (1, range(high + 1, len(order)))):
        for place in places:
            if belongs(place):
                taken.update(held[order[place]])
            elif top:
                break
    for place in (low, high):  # lists and the like that the region cuts
        if order[place] >= 0 and nodes[order[place]].tag in TEXTUAL:
            taken.update(held[order[place]])
    for place in range(low + 1, high):
        taken.update(held[order[place]])
    return taken, left


def main_text(page: str | None, weights: dict[str, float], whole: bool = True) -> tuple[str, float]:
    """The text of the best region, made whole or as it is, and the region's score. Blocks are joined by newlines, white space within
    one is one space."""
    if not page:
        return "", 0.0
    found, elements, _, nodes = parse(page)
    scores, left = scored(found, elements, weights)
    start, end = best_region(scores)
    total = math.fsum(scores[start:end])
    if end > start:  # a block that the region cuts is taken whole
        first, last = found[start].block, found[end - 1].block
        while start > 0 and found[start - 1].block == first:
            start -= 1
        while end < len(found) and found[end].block == last:
            end += 1
    taken = range(start, end)
    if whole and end > start:
        chosen, left = make_whole(found, elements, nodes, scores, left, start, end)
        taken = sorted(chosen)
    blocks: list[tuple[int, list[str]]] = []
    for i in taken:
        t = found[i]
        if t.text is None or left[i]:
            continue
        if not blocks or blocks[-1][0] != t.block:
            blocks.append((t.block, []))
        blocks[-1][1].append(t.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in blocks)
    return "\n".join(x for x in lines if x), total


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 1) -> dict[str, float]:
    """Weights from pages that mark their article, about max_labelled of them chosen by hashes of page_id and html. Only
    counts by feature reach the driver, of which there are as many as kinds of elements and HTML's tags make."""
    labelled = pages.select("page_id", F.col("html").alias("html")).filter(F.col("html").rlike(r"(?i)<article|<main|articlebody"))
    n = labelled.count()
    if not n:
        return learn({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for b in batches:
            for page in b.column(0):
                for f, (inside, outside) in labelled_counts(page.as_py()).items():
                    sums[f][0] += inside
                    sums[f][1] += outside
        yield pa.RecordBatch.from_pydict({"feature": list(sums), "inside": [s[0] for s in sums.values()], "outside": [s[1] for s in sums.values()]}, schema=kind)

    kind = pa.schema([("feature", pa.string()), ("inside", pa.float64()), ("outside", pa.float64())])
    chosen = labelled.filter(unit_hash("page_id", "html", F.lit(seed)) < min(1.0, max_labelled / n))
    sums = chosen.select("html").mapInArrow(count, "feature string, inside double, outside double").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return learn({r["feature"]: (r["i"], r["o"]) for r in sums.collect()})


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Of each row: page_id, url, text (empty where html is null, empty or holds no region of positive score), n_chars (code
    points) and region_score (0 for those). Whole pages are read, malformed and very long ones too; rows that repeat give
    a row each; further columns are not looked at."""
    weights = fit(pages) if weights is None else weights

    @F.arrow_udf("struct<text:string,score:double>")
    def run(pages_: pa.Array) -> pa.Array:
        found = [main_text(p.as_py(), weights) for p in pages_]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["text", "score"])

    out = pages.select("page_id", "url", run(F.col("html")).alias("found"))
    return out.select("page_id", "url", F.col("found")["text"].alias("text"), F.char_length(F.col("found")["text"]).cast("long").alias("n_chars"), F.col("found")["score"].alias("region_score"))
