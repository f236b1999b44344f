"""Tokens of SQL text: one compiled pattern for each dialect."""

from __future__ import annotations

import re
from functools import cache

from .dialects import Dialect


class SqlError(ValueError):
    pass


class Token:
    """kind: word, name (quoted), string, number, hex, bits, op, param, hint, end. upper: the text of a word in capitals, of an op as it is, else empty."""

    __slots__ = ("at", "end", "kind", "text", "upper")

    def __init__(self, kind: str, text: str, at: int, end: int = 0, upper: str = ""):
        self.kind, self.text, self.at, self.end, self.upper = kind, text, at, end, upper

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text}"


_OPS = ("<=>", "->>", "#>>", "!~*", "::", "<=", ">=", "<>", "!=", "||", "&&", "->", "#>", "@>", "<@", "~*", "!~", "<<", ">>", ":=", "(+)", "*=", "=*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "%": "\\%", "_": "\\_"}


@cache
def _pattern(d: Dialect) -> re.Pattern:
    quotes = re.escape("'" + ('"' if d.double_is_string else ""))
    ops = "|".join(map(re.escape, _OPS))
    parts = [
        ("skip", r"\s+"), ("word", r"[^\W\d][\w$#]*"), ("comment", r"--[^\n]*" + (r"|\#[^\n]*" if d.hash_comment else "")), ("block", r"/\*"), ("string", f"[{quotes}]"),
        ("number", r"0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"), ("dollar", r"\$(?P<tag>\w*)\$"), ("quoted", f"[{re.escape(d.quotes)}]"),
        ("json", r"\?[|&]|\?(?=\s*')" if d.name == "postgres" else r"(?!)"), ("op", ops + r"|@@(?!\w)"), ("param", r"[:@]{1,2}\w+|\?"), ("one", r"."),
    ]
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts), re.S)


def _until(sql: str, close: str, start: int, at: int, what: str) -> int:
    j = sql.find(close, start)
    if j < 0:
        raise SqlError(f"{what} that starts at {at} isn't closed")
    return j


def _string(sql: str, at: int, backslash: bool) -> tuple[str, int]:
    """(text, place behind) of the string whose quote is at `at`."""
    quote, i, out = sql[at], at + 1, []
    while True:
        j = _until(sql, quote, i, at, "a string")
        b = sql.find("\\", i, j) if backslash else -1
        if b >= 0:
            out += [sql[i:b], _ESCAPES.get(sql[b + 1 : b + 2], sql[b + 1 : b + 2])]
            i = b + 2
            continue
        out.append(sql[i:j])
        if sql[j + 1 : j + 2] != quote:
            return "".join(out), j + 1
        out.append(quote)
        i = j + 2


def tokens(sql: str, d: Dialect) -> tuple[list[Token], list[str]]:
    """(tokens, comments). Optimizer hints are tokens; other comments are kept apart."""
    out: list[Token] = []
    comments: list[str] = []
    match, i, n = _pattern(d).match, 0, len(sql)
    while i < n:
        m = match(sql, i)
        kind, start, i = m.lastgroup, i, m.end()
        if kind == "skip":
            continue
        text = m[0]
        if kind == "word":
            upper = text.upper()
            if len(text) == 1 and upper in "NXBE" and sql[i : i + 1] == "'":
                j = _until(sql, "'", i + 1, start, "a string")
                out.append(Token({"X": "hex", "B": "bits"}.get(upper, "string"), sql[i + 1 : j], start, j + 1))
                i = j + 1
            else:
                out.append(Token("word", text, start, i, upper))
        elif kind == "op" or kind == "json":
            out.append(Token("op", text, start, i, text))
        elif kind == "one":
            if text in d.quotes:
                kind = "quoted"
            else:
                out.append(Token("op", text, start, i, text))
                continue
        elif kind == "string":
            text, i = _string(sql, start, d.backslash)
            out.append(Token("string", text, start, i))
        elif kind == "number" or kind == "param":
            out.append(Token(kind, text, start, i))
        elif kind == "comment":
            comments.append(text)
        elif kind == "block":
            i = _until(sql, "*/", i, start, "a comment") + 2
            if sql.startswith("/*+", start):
                out.append(Token("hint", sql[start + 3 : i - 2].strip(), start, i))
            else:
                comments.append(sql[start:i])
        elif kind == "dollar":
            j = _until(sql, text, i, start, "a string")
            out.append(Token("string", sql[i:j], start, j + len(text)))
            i = j + len(text)
        if kind == "quoted":
            if text == "[" and out and (out[-1].kind == "name" or out[-1].text in (")", "]")):
                out.append(Token("op", "[", start, i, "["))
                continue
            close = "]" if text == "[" else text
            j = _until(sql, close, i, start, "a name")
            out.append(Token("name", sql[i:j], start, j + 1))
            i = j + 1
    out.append(Token("end", "", n, n))
    return out, comments
