"""HTML: a tree from the standard library's tokenizer, and CSS selection over it, in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, block elements, what a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
KEEP_SPACE = {"pre", "textarea", "plaintext", "xmp", "listing"}
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)  # elements and texts
    begin: int = 0  # where its content begins and ends in the page
    end: int = 0

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        for c in self.elements:
            yield c
            yield from c.walk()

    def text(self) -> str:
        out: list[str] = []
        self._text(out, False)
        return re.sub(r"\s+", " ", "".join(out)).strip() if not any(e.tag in KEEP_SPACE for e in [self, *self.walk()]) else "".join(out).strip()

    def _text(self, out: list[str], keep: bool) -> None:
        if self.tag in ("script", "style"):
            return
        keep = keep or self.tag in KEEP_SPACE
        for c in self.children:
            if isinstance(c, Element):
                if c.tag in BLOCK:
                    out.append(" ")
                c._text(out, keep)
                if c.tag in BLOCK:
                    out.append(" ")
            else:
                out.append(c if keep else re.sub(r"\s+", " ", c))

    def own_text(self) -> str:
        return re.sub(r"\s+", " ", "".join(c for c in self.children if not isinstance(c, Element))).strip()

    def outer_html(self) -> str:
        import html

        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        return f"<{self.tag}{attrs}>{''.join(c.outer_html() if isinstance(c, Element) else html.escape(c, False) for c in self.children)}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", end=len(html))
        self.at = self.root
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        self._leave(self.root, len(html))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, to: Element, place: int) -> None:
        """Ends all open elements inside of `to`."""
        while self.at is not to:
            self.at.end = place
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK and tag not in ("br", "body", "html") else set())
        e = self.at
        while e is not self.root and closes:
            if e.tag in closes:
                self._leave(e.parent, self._place())
                if tag not in ("tr",):
                    break
            elif e.tag in ("ul", "ol", "table", "div", "body", "section", "article"):
                break
            e = e.parent
        place = self._place()
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {}, place)
        place += len(self.get_starttag_text())
        self._open(tag, {k: v or "" for k, v in attrs}, place)
        if tag in VOID:
            self._leave(self.at.parent, place)

    def _open(self, tag, attrs, place):
        e = Element(tag, attrs, self.at, begin=place)
        self.at.children.append(e)
        self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self._leave(e.parent, self._place())

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    return _Builder(html or "").root


# --- selectors

PART = re.compile(r"([#.]?)((?:[\w-]|[^\x00-\x7f])+|\*)|\[\s*([\w-]+)\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?")


def _compound(text: str) -> list[tuple]:
    out, i = [], 0
    while i < len(text):
        m = PART.match(text, i)
        if not m:
            raise ValueError(f"bad selector {text!r}")
        out.append(m.groups())
        i = m.end()
    return out


def _split(selector: str) -> list[tuple[str, list[tuple]]]:
    """[(combinator before, compound)]."""
    out, i, comb, start, depth = [], 0, "", 0, 0
    s = selector.strip()
    buf = ""
    while i <= len(s):
        c = s[i] if i < len(s) else " "
        if c in "([":
            depth += 1
        if c in ")]":
            depth -= 1
        if depth == 0 and (c in " >+~" and not (c == "~" and s[i + 1 : i + 2] == "=")):
            if buf:
                out.append((comb, _compound(buf)))
                buf, comb = "", " "
            if c in ">+~":
                comb = c
        else:
            buf += c
        i += 1
    del start
    return out


def _nth(text: str, n: int) -> bool:
    text = text.strip().lower().replace(" ", "")
    if text in ("odd", "even"):
        return n % 2 == (text == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise ValueError(f"bad place {text!r}")
    if m[3]:
        return n == int(m[3])
    a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    b = int(m[2] or 0)
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _is(e: Element, parts: list[tuple]) -> bool:
    for mark, word, attr, op, v1, v2, v3, pseudo, arg in parts:
        if word:
            if mark == "#" and e.attrs.get("id") != word or mark == "." and word not in e.attrs.get("class", "").split() or not mark and word not in ("*", e.tag) and word.lower() != e.tag:
                return False
        elif attr:
            have, want = e.attrs.get(attr.lower()), v1 if v1 is not None else v2 if v2 is not None else v3
            if op == "!=":
                if have == want:
                    return False
                continue
            if have is None:
                return False
            if op and not {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(f"{want}-"), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have}[op]:
                return False
        elif not _pseudo(e, pseudo, arg):
            return False
    return True


def _pseudo(e: Element, name: str, arg: str | None) -> bool:
    around = e.parent.elements if e.parent else [e]
    same = [x for x in around if x.tag == e.tag]
    place = lambda xs: next(i for i, x in enumerate(xs) if x is e) + 1
    match name:
        case "first-child":
            return around[0] is e
        case "last-child":
            return around[-1] is e
        case "only-child":
            return len(around) == 1
        case "first-of-type":
            return same[0] is e
        case "last-of-type":
            return same[-1] is e
        case "only-of-type":
            return len(same) == 1
        case "nth-child":
            return _nth(arg, place(around))
        case "nth-last-child":
            return _nth(arg, len(around) - place(around) + 1)
        case "nth-of-type":
            return _nth(arg, place(same))
        case "nth-last-of-type":
            return _nth(arg, len(same) - place(same) + 1)
        case "root":
            return e.parent is not None and e.parent.tag == "#root"
        case "empty":
            return not e.elements and not "".join(c for c in e.children if isinstance(c, str)).strip()
        case "not":
            return not any(_chain(e, _split(s)) for s in arg.split(","))
        case "contains":
            return arg.strip("'\"").lower() in e.text().lower()
        case "containsOwn":
            return arg.strip("'\"").lower() in e.own_text().lower()
        case "matches":
            return re.fullmatch(arg, e.text()) is not None
        case "matchesOwn":
            return re.fullmatch(arg, e.own_text()) is not None
    raise ValueError(f"unknown pseudo-class :{name}")


def _chain(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    comb, parts = steps[-1]
    if not _is(e, parts):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if comb == ">":
        return e.parent is not None and e.parent.tag != "#root" and _chain(e.parent, rest)
    if comb in ("+", "~"):
        around = e.parent.elements if e.parent else []
        i = next((k for k, x in enumerate(around) if x is e), 0)
        before = around[i - 1 : i] if comb == "+" and i else around[:i] if comb == "~" else []
        return any(_chain(x, rest) for x in before)
    up = e.parent
    while up is not None and up.tag != "#root":
        if _chain(up, rest):
            return True
        up = up.parent
    return False


def select(root: Element, selector: str) -> list[Element]:
    groups = [_split(s) for s in re.split(r",(?![^(\[]*[)\]])", selector)]
    return [e for e in root.walk() if any(_chain(e, g) for g in groups)]


HITS = "array<struct<text:string,own_text:string,html:string,attrs:map<string,string>>>"


def select_column(html, selector: str) -> Column:
    """All hits in document order."""

    @F.pandas_udf(HITS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"text": e.text(), "own_text": e.own_text(), "html": e.outer_html(), "attrs": e.attrs} for e in select(parse(t), selector)] if t is not None else None)

    return run(html if isinstance(html, Column) else F.col(html))


def text_column(html, selector: str) -> Column:
    """Texts of all hits; the rest isn't sent back."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [e.text() for e in select(parse(t), selector)] if t is not None else None)

    return run(html if isinstance(html, Column) else F.col(html))


def source_column(html, selector: str) -> Column:
    """What stands between the tags of all hits, as the page has it: references aren't decoded, inner tags and white space stay."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [t[e.begin : e.end] for e in select(parse(t), selector)] if t is not None else None)

    return run(html if isinstance(html, Column) else F.col(html))
