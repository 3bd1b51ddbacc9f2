"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; the article is the contiguous region with the largest sum, which one
linear scan finds.  The weights come from labelled pages: pages that mark
their article (one ``article`` or ``main`` element) say which words and tags
lie inside and which outside.  A weight is the logarithm of inside against
outside counts, shrunk to a prior and cut to its sign: the tags of an
article's own paragraphs cost next to nothing, those of menus and layout cost
many words, and a page without marks is scored by the same weights.

Features: words, apart by whether their block is link text alone; tags by
name, apart by whether their block is link text alone; ``zone``: a whole
element that is no article text by its name (nav, footer, aside, form, script,
header outside the article ...), by a word of its class, id or role (menu,
sidebar, cookie, advert, comments ...), or because it is hidden.  A zone is one
negative token of the sequence, worth two words at most, so text on both sides
of an advert still makes one region; its words are never given out.  An element named by its class, or
a form, that holds the page's marked article, is no zone.

Text: blocks that have a word in the region are given out whole; runs of two or
more blocks of link text alone inside the region are menus and left out.
Character references are decoded once, white space inside a block is one
space, blocks are joined by two line ends in page order.

The fit counts features over a sample of about ``FIT_PAGES`` pages, taken by a
hash of the page, in Spark; what comes to the driver is a row per feature (tag
names of HTML, others count as one).  Extraction goes page by page, in linear
time.

Defined results: null and empty html give the empty text; text without tags is
one block; repeated pages and null ids each give a row; unclosed elements,
comments and tags end with the page; an empty table gives no rows; without
labelled pages the priors are the weights; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from tillpoint.llm.common import map_batches, pick

FIT_PAGES = 2000
SHRINK = 20.0               # counts that the prior stands for
LEAST_TAG, MOST_TAG, MOST_ZONE, LEAST_WORD, MOST_WORD = 0.02, 6.0, 2.0, 0.05, 1.0

# Elements of HTML.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead title tr ul""".split())
INLINE = set("""a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label link mark meta
    meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title xmp noembed noframes".split())
LAYOUT = set("article aside body div footer header html main nav section table".split())
NO_TEXT = RAW | set("""nav footer aside form button select datalist dialog menu object audio video canvas svg map head
    input label""".split())
CLOSES_P = BLOCKS - {"title", "head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option",
                     "optgroup", "legend", "summary"}

# Words of a class, id or role that name a part of a page which is no article text.
NAMED = set("""nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs pagination pager paging footer foot
    sidebar sidebars aside rail ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored
    sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert newsletter
    subscribe subscription signup signin login popup modal overlay paywall share sharing social related recommended
    recommendations teaser teasers comment comments respond disqus discussion replies reply widget widgets toolbar
    searchbox searchform copyright colophon contentinfo complementary dialog skip masthead""".split())
HEADER = {"header", "head", "top", "topbar"}
ARTICLE_WORDS = set("article post entry content main story body text page".split())
STATE_WORDS = set("has have with no is js without".split())
NEVER_ZONE = {"html", "body", "main"}

TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role|style|hidden|aria-hidden|itemprop)"
                  r"(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named_zone(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the class, id, role or style of an element says that it holds no article text."""
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" and name != "input":
            return value.lower() != "until-found"
        if key == "aria-hidden":
            if value.lower() == "true":
                return True
        elif key == "style":
            if HIDDEN.search(value):
                return True
        elif key != "itemprop":
            for token in value.split():
                words = [w.lower() for w in WORD_PARTS.findall(token)]
                if not words or words[0] in STATE_WORDS:
                    continue
                if NAMED & set(words) or not in_article and HEADER & set(words) and not ARTICLE_WORDS & set(words):
                    return True
    return False


class Page:
    """A page as a sequence of items, zones found and link-only blocks known.

    ``items``: [kind, text or tag name, block, zone, in link, in the marked article]; kind 0 is text, 1 a tag.
    """

    def __init__(self, source: str):
        self.items: list[list] = []
        self.marks = 0                              # article or main elements that mark the article
        self.block = 0
        # [name, zones around, may hold the mark without being a zone, holds an article, is a zone, is a mark, is a block, first item]
        self._stack: list[list] = []
        self._open: Counter = Counter()
        self._main: list | None = None              # the open main element that is the mark
        self._depth = {"article": 0, "a": 0, "zone": 0, "mark": 0}
        at = 0
        while at < len(source):
            found = TAG.search(source, at)
            end = found.start() if found else len(source)
            if end > at:
                self._text(source[at:end])
            if not found:
                break
            at = found.end()
            name = (found["name"] or "").lower()
            if not name:
                continue                            # comments and declarations
            if found["close"]:
                self._end(name)
            else:
                self._start(name, found["attrs"])
                if name in RAW and not found["attrs"].endswith("/"):
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = close.start() if close else len(source)
        while self._stack:
            self._pop()
        words: dict[int, list[int]] = {}            # words of a block: all, in links
        for kind, text, block, zone, link, _ in self.items:
            if kind == 0 and not zone[0]:
                n = words.setdefault(block, [0, 0])
                n[0] += len(text.split())
                n[1] += len(text.split()) if link else 0
        self.link_only = {b for b, (n, in_links) in words.items() if n == in_links and n}

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.items.append([0, text, self.block, self._zone(), self._depth["a"] > 0, self._depth["mark"] > 0])

    def _zone(self) -> list:
        """The zones around this place; whether one of them holds is known when they have been closed."""
        return self._stack[-1][1] if self._stack else [False]

    def _tag(self, name: str, zone: list | None = None) -> None:
        self.items.append([1, name, self.block, self._zone() if zone is None else zone, False, self._depth["mark"] > 0])

    def _start(self, name: str, attrs: str) -> None:
        if name in CLOSES_P:
            self._implied({"p"}, stop={"button", "table", "td", "th", "caption", "object"})
        if name == "li":
            self._implied({"li"}, stop={"ul", "ol", "menu", "dir"})
        elif name in ("dt", "dd"):
            self._implied({"dt", "dd"}, stop={"dl"})
        elif name in ("td", "th", "tr"):
            self._implied({"td", "th"} | ({"tr"} if name == "tr" else set()), stop={"table"})
        elif name == "option":
            self._implied({"option"}, stop={"select"})
        elif name == "a":
            self._implied({"a"}, stop={"button", "object"})
        if name in BLOCKS:
            self.block += 1
        in_article = self._depth["article"] > 0
        by_class = name not in NEVER_ZONE and name not in VOID and bool(attrs) and named_zone(name, attrs, in_article)
        zone = by_class or name in NO_TEXT or name == "header" and not in_article
        if name in VOID:
            self._tag(name)
            return
        mark = not zone and self._depth["zone"] == 0 and self._depth["mark"] == 0 and name in ("article", "main")
        if name == "article" and self._main and not zone and self._depth["zone"] == 0:
            self._unmark(self._main)                # the article inside main is the mark
            mark = True
        around = self._zone()
        own = [None, around] if zone else around    # [whether it holds, the zone around]
        self._tag("hgroup" if name == "header" and in_article else name, own)   # an article's own header is no page header
        if mark:
            self.marks += 1
            self._depth["mark"] += 1
        if mark or name == "article" and not zone:
            for e in reversed(self._stack):
                if e[3]:
                    break                           # and so do those around it
                e[3] = True
        self._stack.append([name, own, by_class or name == "form", False, zone, mark, name in BLOCKS, len(self.items)])
        self._open[name] += 1
        if mark and name == "main":
            self._main = self._stack[-1]
        self._depth["zone"] += zone
        if name in ("article", "a"):
            self._depth[name] += 1

    def _unmark(self, element: list) -> None:
        element[5], self._main = False, None
        self.marks -= 1
        self._depth["mark"] -= 1
        for item in self.items[element[7]:]:
            item[5] = False

    def _end(self, name: str) -> None:
        if self._open[name]:
            while self._stack[-1][0] != name:
                self._pop()
            self._pop()
        else:
            self._tag(name)
        if name in BLOCKS:
            self.block += 1

    def _implied(self, names: set, stop: set) -> None:
        """Close an element that the next start tag ends."""
        if not any(self._open[n] for n in names):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in stop or self._stack[i][0] in LAYOUT:
                return

    def _pop(self) -> None:
        name, own, droppable, holds, zone, mark, is_block, _ = self._stack.pop()
        self._open[name] -= 1
        if zone:
            own[0] = not (droppable and holds)
            self._depth["zone"] -= 1
        if mark:
            self._depth["mark"] -= 1
            self._main = None
        if name in ("article", "a"):
            self._depth[name] -= 1
        self._tag("hgroup" if name == "header" and self._depth["article"] else name, own)
        if is_block:
            self.block += 1


def settled(zone: list) -> bool:
    """Whether a zone or one around it holds; the answer is kept in all of them."""
    passed = []
    while not zone[0] and len(zone) > 1:
        passed.append(zone)
        zone = zone[1]
    for z in passed:
        z[:] = [zone[0]]
    return bool(zone[0])


def sequence(source: str) -> tuple[list[tuple], Page]:
    """(feature, words, item) of a page; what lies in a zone is one token, without words."""
    page = Page(source)
    out: list[tuple] = []
    in_zone = False
    for i, (kind, text, block, zone, link, mark) in enumerate(page.items):
        if settled(zone):
            if not in_zone:
                out.append(("zone", 0, i))
            in_zone = True
            continue
        in_zone = False
        linked = block in page.link_only
        if kind == 0:
            n = len(text.split())
            if n:
                out.append(("link words" if linked else "words", n, i))
        else:
            name = text if text in BLOCKS or text in INLINE else "other"
            out.append((f"{name} link" if linked else name, 0, i))
    return out, page


def prior(feature: str) -> float:
    if feature == "words":
        return 1.0
    if feature == "link words":
        return 0.1
    if feature == "zone":
        return -2.0
    name = feature.removesuffix(" link")
    return (-3.0 if name in LAYOUT else -0.2 if name in BLOCKS else -0.1) * (5 if feature.endswith(" link") else 1)


def weight(feature: str, inside: float, outside: float) -> float:
    """Logarithm of inside against outside, shrunk to the prior, with the sign that words and tags have."""
    p = 1 / (1 + math.exp(-prior(feature)))
    x = math.log((inside + SHRINK * p) / (outside + SHRINK * (1 - p)))
    if feature in ("words", "link words"):
        return min(MOST_WORD, max(LEAST_WORD, x))
    return max(-MOST_ZONE if feature == "zone" else -MOST_TAG, min(-LEAST_TAG, x))


class Weights(dict):
    """Weights by feature; a feature that no labelled page has gets its prior."""

    def __missing__(self, feature: str) -> float:
        self[feature] = w = weight(feature, 0, 0)
        return w


def counts(source: str) -> Counter:
    """Counts by (feature, inside) of a page that marks its article once; none of other pages."""
    found, page = sequence(source)
    if page.marks != 1:
        return Counter()
    out: Counter = Counter()
    for feature, n, i in found:
        # the tags of the mark itself stand outside it
        out[feature, bool(page.items[i][5]) and page.items[i][1] not in ("article", "main")] += n or 1
    return out


def fit(pages: DataFrame, html_col: str = "html", sample: int = FIT_PAGES) -> dict[str, float]:
    """Weights of the features, from about ``sample`` pages."""
    rows = pick(pages, html=html_col).filter(F.length("html") > 0)
    total = rows.count()
    chosen = rows if total <= sample else rows.filter(F.pmod(F.xxhash64("html"), F.lit(total)) < sample)

    def start():
        def work(batch):
            seen: Counter = Counter()
            for source in batch.column("html"):
                seen += counts(source.as_py())
            keys = list(seen)
            yield {"feature": [k[0] for k in keys], "inside": [k[1] for k in keys], "n": [seen[k] for k in keys]}
        return work
    sums = map_batches(chosen, start, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"))
    return {r["feature"]: weight(*r) for r in sums.collect()}       # a row per tag name of HTML


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous region with the largest sum above 0; the first one of several."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Blocks of the article, joined by two line ends."""
    if not source:
        return ""
    found, page = sequence(source)
    begin, end = best_region([weights[f] * (n or 1) for f, n, _ in found])
    inside = {page.items[i][2] for f, n, i in found[begin:end] if n}
    parts: dict[int, list[str]] = {}
    for kind, text, block, zone, *_ in page.items:
        if block in inside and not settled(zone):
            if kind == 0:
                parts.setdefault(block, []).append(text)
            elif text in ("br", "wbr", "img"):
                parts.setdefault(block, []).append(" " if text == "br" else "")
    blocks = [(b in page.link_only, " ".join("".join(p).split())) for b, p in sorted(parts.items())]
    blocks = [x for x in blocks if x[1]]
    kept = []
    for i, (link, text) in enumerate(blocks):
        menu = link and (i > 0 and blocks[i - 1][0] or i + 1 < len(blocks) and blocks[i + 1][0])
        if not menu:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, weights: dict[str, float], carry: list[str] = ("page_id", "url"), html_col: str = "html"
            ) -> DataFrame:
    """The ``carry`` columns and text."""
    rows = pick(pages, **{"html": html_col} | {f"c_{i}": c for i, c in enumerate(carry)})
    kept = [c for c in rows.columns if c != "html"]
    types = dict(rows.dtypes)

    def start():
        own = Weights(weights)

        def work(batch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield {c: part.column(c) for c in kept} | {
                    "text": [main_text(h.as_py(), own) for h in part.column("html")]}
        return work
    out = map_batches(rows, start, ", ".join([*(f"{c} {types[c]}" for c in kept), "text string"]))
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "text")
