"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of block elements (with their classes) from
the root. Over all nodes that share a path, the length of text outside links and the punctuation
are averaged (the two ratios), smoothed along the page with a small Gaussian, and fused by their
geometric mean. Paths over a share of the spread of the fused values are content; the innermost
element that holds all content, or the article around it, then brings in its other nodes (headings,
short paragraphs, lists). Content is never left out again.
Elements whose HTML meaning is another (navigation, forms, scripts, hidden ones and so on) are left
out before the ratios are taken. A class or id that speaks of something else (``sidebar``) lowers
the fused value: to a hundredth in a name of its own (``ad``, ``share-buttons``), to a half in
another compound (``share-price``); a header inside the article is the article's.

Pages are independent, so nothing is shuffled. Reading a page takes time in proportion to its
length at any depth and however broken it is; memory follows the largest single page.

Defined cases: null, empty and text-free html give an empty string; unclosed and stray tags are
tolerated; a page with a single kind of path is kept whole; extra columns are ignored; a null key
is kept.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math canvas object audio video".split())
NEVER = frozenset("nav footer aside form button select option label fieldset menu dialog head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody thead tr td th ul".split())
#: An element that a sibling of these ends, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Parts of class and id names that mark what isn't the article.
MARKS = frozenset("ad adbox ads adslot advert adverts advertisement advertising adsense announcement aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookiebar cookies disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related recommended recommendations replies reply respond share sharing sidebar sidebox sidenav signup skip skyscraper social sponsor sponsored subnav subscribe subscription teaser teasers toolbar topbar topnav widget alert".split())
#: Those of them that mark what readers wrote, which may be longer than the article.
THREADS = frozenset("comment commentlist comments disqus feedback replies reply respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words that say whose header it is.
OWN = frozenset("article content entry post story".split())
SECTIONS = frozenset("html body article main".split())

#: Words after which a mark in the same name is meant: a list, box or button of it.
BOXES = frozenset("area articles bar block box btn button buttons container content copy count form foot group head heading icon icons inner items label layout link links list main message new outer overlay pane panel post posts row section slot stories story text thread title top unit widgets wrap wrapper".split())
#: What a mark leaves of the fused ratios of an element's text, in a name of its own or of a box, and in another compound.
STRONG, WEAK = 0.01, 0.5

_TEXT = re.compile(r"[^<]+")
_CLOSED = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？]")


class _Element:
    """place: in order of start tags; path: the number of its tag path; factor: what its own marks leave."""

    __slots__ = ("tag", "parent", "place", "depth", "path", "out", "named", "factor", "thread")

    def __init__(self, tag: str, parent: _Element | None, place: int):
        self.tag, self.parent, self.place = tag, parent, place
        self.depth = parent.depth + 1 if parent else 0
        self.out = tag in NEVER or bool(parent and parent.out)
        self.named = self.thread = False
        self.path, self.factor = 0, 1.0


def _factor(name: str, inside: bool) -> tuple[float, bool]:
    """What a class or id leaves of the ratios, and whether it names what readers wrote. inside: of the article."""
    parts = [x.lower() for x in _PART.findall(name)]
    marks = {x for x in parts if x in MARKS}
    if inside or OWN.intersection(parts):
        marks.discard("header")
    if not marks:
        return 1.0, False
    meant = parts[-1] in marks or parts[-1] in BOXES or len(parts[-1]) < 2
    return STRONG if meant else WEAK, meant and bool(marks & THREADS)


class _Reader:
    """Reads a page into blocks in one pass; what it keeps of open elements makes each step cheap at any depth."""

    def __init__(self) -> None:
        self.elements = [_Element("", None, 0)]
        self.paths: dict[tuple, int] = {}
        self.stack = [self.elements[0]]
        self.open: dict[str, list[int]] = {}
        #: (element, text, text outside links) of each block with text
        self.blocks: list[tuple[_Element, str, str]] = []
        self.pieces: list[tuple[str, bool]] = []

    def last(self, tags) -> int:
        """The place in the stack of the innermost open element with one of the tags; 0: none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.open[self.stack.pop().tag].pop()

    def push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1]
        e = _Element(tag, parent, len(self.elements))
        inside = bool(self.open.get("article") or self.open.get("main"))
        if tag == "header":
            e.out = e.out or not inside
        classes = ""
        if attributes:
            own: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                own.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
            classes = " ".join(sorted(own.get("class", "").split()))
            style = own.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            e.out = e.out or hidden or own.get("role", "").lower() in ROLES
            names = [_factor(x, inside) for x in (*classes.split(), *own.get("id", "").split())]
            e.named = any(f < 1 for f, _ in names)
            if tag not in SECTIONS:
                e.factor = min((f for f, _ in names), default=1.0)
                e.thread = any(t for _, t in names)
        e.path = self.paths.setdefault((parent.path, tag, classes), len(self.paths) + 1)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)
        self.elements.append(e)

    def end_block(self) -> None:
        """A block holds what stands between two block tags."""
        if self.pieces and not self.stack[-1].out:
            text = " ".join("".join(t for t, _ in self.pieces).split())
            if text:
                self.blocks.append((self.stack[-1], text, " ".join("".join(t for t, linked in self.pieces if not linked).split())))
        self.pieces = []

    def read(self, page: str) -> None:
        at, linked, n, last = 0, False, len(page), page.rfind(">")
        while at < n:
            if page[at] != "<":
                m = _TEXT.match(page, at)
                self.pieces.append((html.unescape(m[0]), linked))
                at = m.end()
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            m = _CLOSED.match(page, at) if at < last else None
            if m is None:
                if at < last and page[at + 1] in "!?/":
                    at = page.index(">", at) + 1
                else:
                    self.pieces.append(("<", linked))
                    at += 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                linked = linked and tag != "a" and tag in INLINE
                if tag not in INLINE:
                    self.end_block()
                    if self.open.get(tag):
                        self.cut(self.open[tag][-1])
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if tag in INLINE:
                linked = linked or tag == "a"
                if tag == "br":
                    self.pieces.append((" ", linked))
                continue
            self.end_block()
            linked = False
            if tag in ENDS_P and self.open.get("p"):
                self.cut(self.open["p"][-1])
            if tag in SIBLINGS:
                ends, stops = SIBLINGS[tag]
                while self.last(ends) > self.last(stops):
                    self.cut(self.last(ends))
            if tag not in VOID and not m[3].endswith("/"):
                self.push(tag, m[3])
        self.end_block()


def _smooth(values: list[float], weights: list[float], width: int = 1) -> list[float]:
    kernel = [math.exp(-(j * j) / 2) for j in range(-width, width + 1)]
    out = []
    for i in range(len(values)):
        got = [(kernel[j + width] * (weights[i + j] if j else 1.0), values[i + j]) for j in range(-width, width + 1) if 0 <= i + j < len(values)]
        out.append(sum(k * v for k, v in got) / sum(k for k, _ in got))
    return out


def content(paths: list[int], chars: list[int], marks: list[int], factors: list[float], share: float = 0.35) -> list[bool]:
    """Which blocks are content, by the fused ratios of their paths.

    chars, marks: text and punctuation outside links; factors: what the marks on a block's elements leave of its
    value. A marked block counts so much less as a neighbour and in the threshold's mean and spread, too.
    """
    sums: dict[int, list[float]] = {}
    for path, a, b in zip(paths, chars, marks, strict=True):
        one = sums.setdefault(path, [0, 0, 0])
        one[0] += 1
        one[1] += a
        one[2] += b
    texts = _smooth([sums[p][1] / sums[p][0] for p in paths], factors)
    points = _smooth([sums[p][2] / sums[p][0] for p in paths], factors)
    fused: dict[int, list[float]] = {}
    for path, a, b in zip(paths, texts, points, strict=True):
        fused.setdefault(path, []).append(math.sqrt(a * (b + 0.1)))
    level = {p: sum(v) / len(v) * (1 if sums[p][1] else 0) for p, v in fused.items()}
    values = [level[p] * f for p, f in zip(paths, factors, strict=True)]
    weight = sum(factors)
    mean = sum(v * f for v, f in zip(values, factors, strict=True)) / weight
    spread = math.sqrt(sum((v - mean) ** 2 * f for v, f in zip(values, factors, strict=True)) / weight)
    bar = min(share * max(values), max(spread, share * mean))
    return [v > 0 and v >= bar for v in values]


def _below(elements: list[_Element], blocks: list[tuple], amounts: list[int]) -> list[int]:
    """Sum of the blocks' amounts in each element, its descendants' included."""
    out = [0] * len(elements)
    for (e, *_), x in zip(blocks, amounts, strict=True):
        out[e.place] += x
    for e in reversed(elements[1:]):
        out[e.parent.place] += out[e.place]
    return out


def _around_article(elements: list[_Element], filled: list[int]) -> set[int]:
    """Places of the elements around main, or without one around the page's only article that has no mark of its own."""
    found = {t: [e for e in elements if e.tag == t and filled[e.place] and not e.named] for t in ("main", "article")}
    own = found["main"] or (found["article"] if len(found["article"]) == 1 else [])
    around: set[int] = set()
    for e in own:
        e = e.parent
        while e is not None and e.place not in around:
            around.add(e.place)
            e = e.parent
    return around


def _factors(elements: list[_Element], blocks: list[tuple], chars: list[int]) -> list[float]:
    """For each element what the marks on it and around it leave. A mark on an element around the article is a name by chance.

    If next to nothing is without a strong mark (a tenth of the text), so is the mark that has most text, and
    so on. What readers wrote doesn't count for that, however long.
    """

    def falling(chance: set[int], of=lambda e: e.factor) -> list[float]:
        out = [1.0] * len(elements)
        for e in elements[1:]:
            out[e.place] = min(out[e.parent.place], 1.0 if e.place in chance else of(e))
        return out

    chance = _around_article(elements, _below(elements, blocks, [1] * len(blocks)))
    thread = falling(chance, lambda e: STRONG if e.thread else 1.0)
    own = [c if thread[e.place] == 1 else 0 for (e, *_), c in zip(blocks, chars, strict=True)]
    total = sum(own)
    below = _below(elements, blocks, own)
    order = sorted((e for e in elements if e.factor == STRONG and not e.thread and e.place not in chance and below[e.place]), key=lambda e: (-below[e.place], e.place))

    def left(n: int) -> list[float]:
        return falling(chance | {e.place for e in order[:n]})

    def enough(n: int) -> bool:
        out = left(n)
        return 10 * sum(c for (e, *_), c in zip(blocks, own, strict=True) if out[e.place] > STRONG) >= total

    low, high = 0, len(order)
    while low < high:  # the fewest marks by chance that leave enough
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return left(low)


def _holder(elements: list[_Element], blocks: list[tuple], chosen: list[bool]) -> _Element:
    """The innermost element around all of the chosen blocks, or the article or main element around it."""
    inside = _below(elements, blocks, [int(x) for x in chosen])
    e = max((e for e in elements if inside[e.place] == inside[0]), key=lambda e: e.depth)
    up = e
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        return up
    while e.parent is not None and (e.tag == "p" or e.tag in HEADINGS):
        e = e.parent
    return e


def extract(page: str | None) -> str:
    """Main text: blocks in page order, joined by an empty line."""
    reader = _Reader()
    reader.read(page or "")
    blocks, elements = reader.blocks, reader.elements
    if not blocks:
        return ""
    chars = [len(free) for _, _, free in blocks]
    below = _factors(elements, blocks, chars)
    factors = [below[e.place] for e, *_ in blocks]
    chosen = content([e.path for e, *_ in blocks], chars, [len(_PUNCTUATION.findall(free)) for *_, free in blocks], factors)
    if not any(chosen):
        return ""
    inner = _holder(elements, blocks, chosen)
    within = [False] * len(elements)
    for e in elements:
        within[e.place] = e is inner or e.parent is not None and within[e.parent.place]
    least = max(f for f, yes in zip(factors, chosen, strict=True) if yes)
    out = []
    for (e, text, free), f, yes in zip(blocks, factors, chosen, strict=True):
        near = inner is not elements[0] and within[e.place] and 2 * len(free) >= len(text) and (f > STRONG or f >= least)
        if yes or near:
            out.append(text)
    return "\n\n".join(out)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    kept = pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.col(page).cast("string").alias("html"))
    return kept.mapInArrow(run, f"{key} long, {url} string, text string, n_chars long")
