"""HTML extraction: gradient-boosted trees over DOM-node features, decoded over the hierarchy.

A page is parsed into a tree whose nodes are block elements (and inline ones with a class or id). Each node gets features: its
subtree's text, link and tag density, attribute tokens of itself and its ancestors, depth, place and lengths among siblings,
share of the page. Trees (numpy, fitted on pages that a seeded generator writes with known article parts) give each node a log-odds of
being article. Decoding takes the labelling of the greatest sum in which nothing below a dropped node is kept.

Text: character references decoded; white space (Unicode) inside a block becomes one space; blocks, and the two sides of a
line break, are joined by one space; inline markup joins without one. Scripts, styles, comments, head and templates have no
text. A null or empty page, or one without text, gives an empty string. Pages are judged one by one: repeats get equal text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_column, read

# A tag whose attributes are closed before the next "<": most are. No alternative can start where another has failed, so a failure costs the way to that "<".
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"=\s*+[\"']|>")  # what matters inside a tag: a quoted value, the end
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++))""", re.I)
GOLD = re.compile(r'data-g="(\d)"')
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements without content, with raw content, without visible text, inline; and what a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title iframe svg canvas object select datalist".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = set("ul ol dl table body html div section article main aside nav header footer form blockquote td th".split())

CELLS = {"td", "th"}
TABLE_PARTS = {"td", "th", "tr", "tbody"}

# Attribute words by what they usually mark.
GOOD = set("article post content entry story main body text hentry prose markdown paragraph blog news page single detail".split())
BAD = set(
    "nav navigation navbar menu menubar submenu sidebar side aside rail footer foot bottom header head masthead banner top topbar ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion "
    "promoted cookie cookies consent gdpr notice alert warning message notification popup modal overlay dialog newsletter subscribe subscription signup login register search form share sharing social "
    "related recommended recommendation popular trending more links breadcrumb breadcrumbs crumb pagination pager paging tags tag widget toolbar tool legal copyright disclaimer skip outbrain taboola contentinfo complementary".split()
)
TALK = set("comment comments commentlist discussion reply replies respond response responses disqus feedback thread reviews".split())
KINDS = {k: i + 1 for i, group in enumerate(("p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div", "section", "article", "main", "nav menu", "header", "footer", "aside", "form fieldset input button label textarea", "table tbody thead tr td th", "figure figcaption")) for k in group.split()}


class Tags:
    """Where a tag ends, for a page: each stretch of the page is looked at a fixed number of times, whatever it holds."""

    def __init__(self, source: str):
        self.source, self.dead, self.cached = source, set(), {}

    def next(self, what: str, at: int) -> int:
        """The first place of `what` from `at`, or -1. A search that went over `at` before isn't made again."""
        lo, found = self.cached.get(what, (0, -2))
        if found == -2 or at < lo or 0 <= found < at:
            found = self.source.find(what, at)
            self.cached[what] = (at, found)
        return found

    def end(self, at: int) -> int:
        """Behind the ">" that closes a tag, `at` standing behind its name. Quoted values may hold ">"; if a quote stays open, the next ">"
        closes the tag; -1 if there is none. Quotes that an earlier open scan went over are known to lead nowhere."""
        i, went = at, []
        last = self.next(">", at)
        while last >= 0:
            # No stop can lie behind the next ">", so that a search is never longer than the way to it.
            m = STOP.search(self.source, i, max(self.next(">", i), i) + 1)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            opened = m.end() - 1
            if opened in self.dead:
                break
            went.append(opened)
            closed = self.next(m[0][-1], opened + 1)
            if closed < 0 or self.next(">", closed) < 0:
                break
            i = closed + 1
        self.dead.update(went)
        return last + 1 if last >= 0 else -1


class Page:
    """Parallel lists over nodes in page order (parents before children), and text pieces: (node, text) or None for a boundary.

    Open elements are kept with the places of each name, of blocks and of scopes, so that no tag searches the whole stack.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.gold, self.link, self.pieces = [-1], ["html"], [()], [None], [0], []
        self.n_tags, self.n_inputs, self.inline = [0], [0], [False]
        self._parse(source)

    def _marks(self, attrs: str) -> int | None:
        """What training pages say of a node; other pages say nothing."""
        return None

    def _node(self, parent: int, tag: str, attrs: str, inline: bool) -> int:
        words = ()
        for m in ATTR.finditer(attrs) if attrs else ():
            words += tuple(w.lower() for w in TOKEN.findall(m[2] or m[3] or m[4] or ""))
        for list_, x in ((self.parent, parent), (self.tag, tag), (self.words, words), (self.gold, self._marks(attrs)), (self.link, 0), (self.n_tags, 0), (self.n_inputs, 0), (self.inline, inline)):
            list_.append(x)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node that gets their text
        where: dict[str, list[int]] = {"html": [0]}  # name -> its places in the stack
        blocks, scopes, frames = [0], [0], [0]  # places of blocks, of what ends a search, and of that without table cells
        links = hidden = 0

        def push(name: str, node: int) -> None:
            at = len(stack)
            stack.append((name, node))
            where.setdefault(name, []).append(at)
            if name not in INLINE:
                blocks.append(at)
                if name in SCOPE:
                    scopes.append(at)
                    if name not in CELLS:
                        frames.append(at)

        def cut(to: int) -> None:
            nonlocal links, hidden
            while len(stack) > to:
                name, _ = stack.pop()
                where[name].pop()
                for places in (blocks, scopes, frames):
                    if places[-1] == len(stack):
                        places.pop()
                links -= name == "a"
                hidden -= name in HIDDEN

        tags = Tags(source)
        at, n, seen = 0, len(source), 0  # text from `seen` on isn't taken yet
        while at < n:
            start = source.find("<", at)
            if start < 0:
                start = at = n
                closing = name = attrs = ""
            elif m := TAG.match(source, start):
                closing, name, attrs = m[1], m[2].lower(), m[3]
                at = m.end()
            elif m := NAME.match(source, start):
                at = tags.end(m.end())
                if at < 0:  # no tag: text
                    at = start + 1
                    continue
                closing, name, attrs = m[1], m[2].lower(), source[m.end() : at - 1]
            elif source.startswith("<!--", start):
                closing = name = attrs = ""
                at = start + 4 if source.startswith(">", start + 4) else start + 5 if source.startswith("->", start + 4) else tags.next("-->", start + 4) + 2
                at = at + 1 if at > start + 1 else n
            elif source[start + 1 : start + 2] in ("!", "?", "/") and (at := tags.next(">", start)) >= 0:
                closing = name = attrs = ""
                at += 1
            else:
                at = start + 1
                continue
            if start > seen and not hidden:
                text = source[seen:start]
                node = stack[-1][1]
                self.pieces.append((node, text))
                if links:
                    self.link[node] += len(text)
            seen = at
            if not name:
                continue
            if closing:
                places = where.get(name)
                # An inline end tag doesn't reach out of a block.
                if places and places[-1] > 0 and not (name in INLINE and blocks[-1] > places[-1]):
                    cut(places[-1])
                    if name not in INLINE:
                        self.pieces.append(None)
                elif name == "p" or name == "br":
                    self.pieces.append(None)
                continue
            inline = name in INLINE
            if not inline and name not in VOID:
                closes = CLOSES.get(name, ()) if name in RAW else (*CLOSES.get(name, ()), "p")
                limits = frames if name in TABLE_PARTS else scopes
                while (to := max((where[c][-1] for c in closes if where.get(c)), default=0)) > 0 and (to >= limits[-1] if stack[to][0] in SCOPE else to > limits[-1]):
                    cut(to)
                    if name not in ("tbody", "tr"):
                        break
            node = stack[-1][1]
            self.n_tags[node] += 1
            if name in VOID:
                self.n_inputs[node] += name == "input"
                if name in ("br", "hr"):
                    self.pieces.append(None)
                continue
            if name in ("button", "textarea", "label"):
                self.n_inputs[node] += 1
            if not inline:
                self.pieces.append(None)
            if not hidden and name not in ("html", "body") and name not in HIDDEN and (not inline or "class" in attrs or "id" in attrs):
                node = self._node(node, name, attrs, inline)
            if attrs.endswith("/") and (inline or name not in KINDS):
                continue  # self-closed
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                end = close.start() if close else n
                if not hidden and name not in HIDDEN and end > at:
                    self.pieces.append((node, source[at:end]))
                at = seen = close.end() if close else n
                continue
            push(name, node)
            links += name == "a"
            hidden += name in HIDDEN

    def text(self, keep: list[bool] | np.ndarray) -> str:
        out: list[str] = []
        for p in self.pieces:
            if p is None:
                out.append(" ")
            elif keep[p[0]]:
                out.append(p[1])
        text = "".join(out)
        return " ".join((html_lib.unescape(text) if "&" in text else text).split())


class TrainingPage(Page):
    """A generated page, whose data-g attributes say what is article."""

    def _marks(self, attrs: str) -> int | None:
        m = GOLD.search(attrs)
        return int(m[1]) if m else None


N_FEATURES = 27


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    own, marks, start = [0] * n, [0] * n, [-1] * n
    at = 0
    for p in page.pieces:
        if p is not None:
            node, text = p
            size = len(text) if not text.isspace() else 0
            own[node] += size
            marks[node] += text.count(".") + text.count(",")
            if start[node] < 0 and size:
                start[node] = at
            at += size
    sub, link, tags, mark, inputs, kids = own[:], page.link[:], page.n_tags[:], marks[:], page.n_inputs[:], [0] * n
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        link[p] += link[i]
        tags[p] += tags[i]
        mark[p] += mark[i]
        inputs[p] += inputs[i]
        kids[p] += 1
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    seen, last = [0] * n, [-1] * n
    previous, following = [0] * n, [0] * n
    depth, good, bad, talk, above = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    rows = np.zeros((n, N_FEATURES))
    place = [0] * n
    total = max(sub[0], 1)
    for i in range(n):
        p = parent[i]
        words = page.words[i]
        g, b, t = (len(GOOD.intersection(words)), len(BAD.intersection(words)), len(TALK.intersection(words))) if words else (0, 0, 0)
        kind = KINDS.get(page.tag[i], 0)
        up = 0
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = seen[p]
            seen[p] += 1
            if last[p] >= 0:
                previous[i] = sub[last[p]]
                following[last[p]] = sub[i]
            last[p] = i
            up = above[p]
        good[i] = g + (good[p] if p >= 0 else 0)
        bad[i] = b + (bad[p] if p >= 0 else 0)
        talk[i] = t + (talk[p] if p >= 0 else 0)
        above[i] = up | (1 if kind in (7, 8) else 2 if kind in (9, 10, 11, 12) else 4 if kind == 13 else 0)
        rows[i] = (
            kind, depth[i], sub[i], own[i], link[i] / max(sub[i], 1), sub[i] / (1 + tags[i]), mark[i] * 100 / max(sub[i], 1), sub[i] / total, start[i] / total if start[i] >= 0 else 0,
            kids[i], place[i], 0, 0, previous[i], 0, g, b, t, good[i] - g, bad[i] - b, talk[i] - t, up & 1, up & 2, up & 4, inputs[i], tags[i], (sub[i] - link[i]) / max(kids[i], 1),
        )
    up = np.array(parent)
    has = up >= 0
    siblings = np.array(kids)[up[has]]
    rows[has, 11] = siblings
    rows[has, 12] = np.array(sub)[up[has]] / np.maximum(siblings, 1)
    rows[:, 14] = following
    return rows


# --- trees -------------------------------------------------------------------------------------------------------


class BoostedTrees:
    """Logistic loss, depth-limited trees over quantile bins, second-order leaf values."""

    def __init__(self, n_trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2 = n_trees, depth, rate, bins, l2
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = at - first
                gain_best = np.full(width, 1e-6)
                for j in range(d):
                    key = local * self.bins + binned[:, j]
                    gs = np.cumsum(np.bincount(key, g, width * self.bins).reshape(width, -1), 1)
                    hs = np.cumsum(np.bincount(key, h, width * self.bins).reshape(width, -1), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(width), k] > gain_best
                    gain_best[better] = gain[np.arange(width), k][better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = k[better]
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
            leaf = at - ((1 << self.depth) - 1)
            value = -self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.l2)
            raw += value[leaf]
            # Thresholds in the features' own units: right if x > threshold.
            threshold = np.array([self.edges[f][c] if c < len(self.edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
            self.trees.append((feature, threshold, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (len(value) - 1)]
        return out


def decode(page: Page, raw: np.ndarray) -> list[bool]:
    """The consistent labelling of the greatest sum of log-probabilities: below a dropped node nothing is kept."""
    n = len(page.tag)
    keep_gain = -np.log1p(np.exp(-raw))
    drop_gain = -np.log1p(np.exp(raw))
    keep, drop = keep_gain.tolist(), drop_gain.tolist()
    keep[0] += 1e6  # the root is only a frame
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] >= drop[i]
    return out


# --- pages to learn from -----------------------------------------------------------------------------------------


class PageWriter:
    """Pages of many layouts; data-g says what is article (1) or not (0)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def words(self, a: int, b: int) -> str:
        parts = ("re", "th", "on", "er", "an", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro")
        return " ".join("".join(parts[i] for i in self.r.integers(0, len(parts), self.r.integers(1, 5))) for _ in range(self.r.integers(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(1, 22).capitalize() + self.pick(".", ".", ".", "!", "?") for _ in range(self.r.integers(a, b)))

    def pick(self, *of):
        return of[self.r.integers(len(of))]

    def yes(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def attr(self, *names: str) -> str:
        if not names or self.yes(0.15):
            return ""
        name = self.pick(*names) + (self.pick("", "", "-wrap", "-inner", "-1", "_box"))
        return self.pick(f' class="{name}"', f' id="{name}"', f" class='{self.pick('c', 'js', 'u')} {name}'")

    def menu(self, tag: str = "nav", *names: str) -> str:
        items = "".join(f'<li data-g="0"><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(self.r.integers(3, 12)))
        return f'<{tag} data-g="0"{self.attr(*names)}><ul data-g="0">{items}</ul></{tag}>'

    def block(self, tag: str, text: str, *names: str) -> str:
        inner = text if self.yes(0.5) else f'<p data-g="0">{text}</p>'
        return f'<{tag} data-g="0"{self.attr(*names)}>{inner}</{tag}>'

    def article(self) -> str:
        out = [f'<h1 data-g="1">{self.words(3, 12)}</h1>'] if self.yes(0.85) else []
        short = self.yes(0.15)
        if short and self.yes(0.5):
            out = [f'<h1 data-g="1">{(said := self.sentences(1, 2))}</h1>', f'<p data-g="1">{said}</p>']
        for _ in range(self.r.integers(0, 3) if short and out else self.r.integers(1, 14)):
            k = self.r.random()
            text = self.sentences(1, 3 if short or self.yes(0.25) else 9)
            if self.yes(0.15):
                text = f"<b>{text}<br>" if self.yes(0.5) else f'{text} <a href="#">{self.words(1, 4)}</a> {self.words(2, 9)}.'
            if k < 0.78:
                out.append(f'<p data-g="1">{text}</p>' if self.yes(0.8) else f'<p data-g="1">{text}')
            elif k < 0.84:
                out.append(f'<h2 data-g="1">{self.words(2, 8)}</h2>')
            elif k < 0.9:
                out.append('<ul data-g="1">' + "".join(f'<li data-g="1">{self.sentences(1, 3)}</li>' for _ in range(self.r.integers(2, 6))) + "</ul>")
            elif k < 0.94:
                out.append(f'<blockquote data-g="1">{text}</blockquote>')
            elif k < 0.97:
                out.append(f'<div data-g="1">{text}</div>')
            else:
                out.append(self.block("div", self.sentences(1, 3), "ad", "advert", "promo", "sponsored", "newsletter"))
        return "".join(out)

    def comments(self) -> str:
        one = lambda: f'<{(t := self.pick("div", "li", "article"))} data-g="0"{self.attr("comment", "reply", "comment-body")}><p data-g="0">{self.sentences(1, 5)}</p></{t}>'
        tag = self.pick("div", "section", "div", "ul", "aside")
        head = f'<h3 data-g="0">{self.words(1, 3)}</h3>' if self.yes(0.5) else ""
        return f'<{tag} data-g="0"{self.attr("comments", "discussion", "responses", "comment-list", "reader-comments")}>{head}{"".join(one() for _ in range(self.r.integers(1, 6)))}</{tag}>'

    def form(self) -> str:
        fields = "".join(f'<label data-g="0">{self.words(1, 3)}</label><input name="x">' for _ in range(self.r.integers(1, 4)))
        return f'<form data-g="0"{self.attr("search", "subscribe", "login", "newsletter-form", "contact")}>{self.sentences(0, 2)}{fields}<button data-g="0">{self.words(1, 3)}</button></form>'

    def sidebar(self) -> str:
        parts = "".join(self.pick(lambda: self.menu("div", "widget", "related"), lambda: self.block("div", self.sentences(1, 4), "widget", "about", "promo"), lambda: f'<h3 data-g="0">{self.words(1, 4)}</h3><p data-g="0">{self.sentences(1, 3)}</p>')() for _ in range(self.r.integers(1, 4)))
        return f'<{(t := self.pick("aside", "div", "div", "section"))} data-g="0"{self.attr("sidebar", "side", "rail", "right-column")}>{parts}</{t}>'

    def page(self) -> str:
        top, bottom = [], []
        if self.yes(0.6):
            top.append(self.pick(lambda: self.block("header", self.words(1, 12), "header", "masthead", "top"), lambda: f'<header data-g="0"><h1 data-g="0">{self.words(1, 5)}</h1>{self.menu()}</header>', lambda: self.block("div", self.words(1, 9), "header", "site-title", "banner"))())
        if self.yes(0.8):
            top.append(self.menu(self.pick("nav", "nav", "div"), "nav", "menu", "navbar", "main-menu"))
        if self.yes(0.4):
            top.append(self.block(self.pick("div", "section", "p"), self.sentences(1, 4), "cookie", "notice", "consent", "alert", "gdpr-banner"))
        if self.yes(0.6):
            top.append(self.block("div", self.sentences(1, 4), "ad", "ads", "advert", "sponsor", "promo"))
        if self.yes(0.25):
            top.append(self.form())
        if self.yes(0.2):
            top.append(self.menu(self.pick("div", "ol"), "breadcrumb", "crumbs"))
        if self.yes(0.3):
            top.append(self.sidebar())
        tag, names = self.pick(("article", ()), ("article", ("post", "entry")), ("main", ("content",)), ("div", ("content", "article-body", "post", "story", "entry-content")), ("div", ("main", "text", "page-content")), ("section", ("article", "story")))
        body = f'<{tag} data-g="1"{self.attr(*names) if tag in ("article", "main") or self.yes(0.1) else self.pick(" class=", " id=") + chr(34) + self.pick(*names) + chr(34)}>{self.article()}</{tag}>'
        if self.yes(0.3):
            body = f'<{(t := self.pick("main", "div", "div"))} data-g="1"{self.attr("container", "wrapper", "layout", "page")}>{body}{self.sidebar() if self.yes(0.4) else ""}</{t}>'
        for p, make in ((0.4, self.comments), (0.3, self.sidebar), (0.2, self.form), (0.25, lambda: self.menu("div", "related", "share", "tags")), (0.3, lambda: self.block("div", self.sentences(1, 3), "ad", "promo", "newsletter", "cookie-notice"))):
            if self.yes(p):
                bottom.append(make())
        if self.yes(0.8):
            bottom.append(self.pick(lambda: self.block("footer", "&copy; " + self.words(1, 14), "footer"), lambda: self.block("div", "&copy; " + self.words(1, 14), "footer", "copyright", "legal"), lambda: f'<footer data-g="0">{self.menu("div", "links")}<p data-g="0">{self.sentences(1, 3)}</p></footer>')())
        return f"<html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(top)}{body}{''.join(bottom)}</body></html>"


_MODEL: list[BoostedTrees] = []


def model(n_pages: int = 900, seed: int = 3) -> BoostedTrees:
    """Fitted once in a process, on the same pages each time."""
    if not _MODEL:
        writer, xs, ys = PageWriter(seed), [], []
        for _ in range(n_pages):
            page = TrainingPage(writer.page())
            gold = np.array([-1 if g is None else g for g in page.gold])
            xs.append(features(page)[gold >= 0])
            ys.append(gold[gold >= 0])
        _MODEL.append(BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float)))
    return _MODEL[0]


def texts(trees: BoostedTrees, sources: list[str | None]) -> Iterator[str]:
    for lo in range(0, len(sources), 64):
        pages = [Page(s or "") for s in sources[lo : lo + 64]]
        rows = [features(p) for p in pages]
        raw = trees.raw(np.concatenate(rows))
        at = 0
        for page, x in zip(pages, rows, strict=True):
            yield page.text(decode(page, raw[at : at + len(x)]))
            at += len(x)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """keep, text_col and n_col (its code points): one row for each page, in one narrow pass. A kept column named as a result gives way to it."""
    handle = pages.sparkSession.sparkContext.broadcast(model())

    def run(html):
        return pa.array(texts(handle.value, html.to_pylist()), pa.string())

    # The page itself isn't kept: add_column replaces it by the text.
    kept = [c for c in keep if c.lower() not in (text_col.lower(), n_col.lower())]
    rows = add_column(pages.select(*kept, F.col(html_col).alias(text_col)), text_col, "string", run, text_col, rows=256)
    return rows.withColumn(n_col, F.length(text_col).cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
