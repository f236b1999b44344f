"""YAML: block mappings and lists, flow collections, quoted and block texts, anchors, several documents. For configuration and small files."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain scalars that aren't text.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
KEY = re.compile(r"((?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'\"%@`-][^#]*?|-[^\s:][^#]*?))\s*:(?:\s+|$)")


class YamlError(ValueError):
    pass


def scalar(text: str) -> Any:
    text = text.strip()
    if text in WORDS:
        return WORDS[text]
    if text[0] == '"':
        return json.loads(text)
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"0x[0-9a-fA-F]+", text):
        return int(text, 16)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


class _Document:
    def __init__(self, lines: list[str]):
        self.rows: list[tuple[int, str]] = []
        self.raw = lines
        for i, line in enumerate(lines):
            body = self.uncommented(line)
            if body.strip():
                self.rows.append((i, body.rstrip()))
        self.at, self.anchors = 0, {}

    @staticmethod
    def uncommented(line: str) -> str:
        quote = ""
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:"):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                return line[:i]
        return line

    def indent(self) -> int:
        if self.at >= len(self.rows):
            return -1
        text = self.rows[self.at][1]
        if "\t" in text[: len(text) - len(text.lstrip())]:
            raise YamlError(f"a tab indents line {self.rows[self.at][0] + 1}")
        return len(text) - len(text.lstrip(" "))

    def node(self, least: int) -> Any:
        n = self.indent()
        if n < least:
            return None
        text = self.rows[self.at][1].strip()
        if text == "-" or text.startswith("- "):
            return self.sequence(n)
        if KEY.match(text):
            return self.mapping(n)
        self.at += 1
        parts = [text]
        while self.indent() >= least and not KEY.match(self.rows[self.at][1].strip()) and self.at < len(self.rows):
            parts.append(self.rows[self.at][1].strip())
            self.at += 1
        return self.value(" ".join(parts), least)

    def sequence(self, n: int) -> list:
        out = []
        while self.indent() == n and re.match(r"-(\s|$)", self.rows[self.at][1].strip()):
            i, text = self.rows[self.at]
            rest = text.strip()[1:]
            if rest.strip():
                # The rest stands as a line of its own, indented behind the dash.
                pad = n + 1 + len(rest) - len(rest.lstrip())
                if KEY.match(rest.strip()) or rest.strip().startswith("- "):
                    self.rows[self.at] = (i, " " * pad + rest.strip())
                    out.append(self.node(pad))
                else:
                    self.at += 1
                    out.append(self.value(rest.strip(), n + 1))
            else:
                self.at += 1
                out.append(self.node(n + 1))
        return out

    def mapping(self, n: int) -> dict:
        out: dict = {}
        merged: list[dict] = []
        while self.indent() == n:
            i, text = self.rows[self.at]
            m = KEY.match(text.strip())
            if not m:
                raise YamlError(f"no key in line {i + 1}")
            key, rest = scalar(m[1]), text.strip()[m.end() :].strip()
            self.at += 1
            name = ""
            if a := re.match(r"&(\S+)\s*", rest):
                name, rest = a[1], rest[a.end() :]
            if rest:
                v = self.value(rest, n + 1)
            elif self.indent() == n and self.rows[self.at][1].strip().startswith("-"):
                v = self.sequence(n)  # a list may stand at its key's indent
            else:
                v = self.node(n + 1)
            if name:
                self.anchors[name] = v
            if key == "<<":
                merged += v if isinstance(v, list) else [v]
            elif key in out:
                raise YamlError(f"key {key} comes twice, in line {i + 1}")
            else:
                out[key] = v
        for m in merged:
            out = {**m, **out}
        return out

    def value(self, text: str, least: int) -> Any:
        if a := re.match(r"&(\S+)\s+", text):
            v = self.value(text[a.end() :], least)
            self.anchors[a[1]] = v
            return v
        if text.startswith("*"):
            if text[1:] not in self.anchors:
                raise YamlError(f"unknown anchor {text}")
            return self.anchors[text[1:]]
        text = re.sub(r"^!!?\S*\s+", "", text)
        if m := re.fullmatch(r"([|>])([-+]?)\d?", text):
            return self.block(m[1], m[2], least)
        if text[0] in "[{":
            while self._open(text):
                if self.at >= len(self.rows):
                    raise YamlError("a flow collection isn't closed")
                text += " " + self.rows[self.at][1].strip()
                self.at += 1
            v, end = self.flow(text, 0)
            if text[end:].strip():
                raise YamlError(f"unexpected {text[end:]!r}")
            return v
        return scalar(text)

    @staticmethod
    def _open(text: str) -> bool:
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "", text)
        return sum(bare.count(c) for c in "[{") > sum(bare.count(c) for c in "]}")

    def flow(self, s: str, i: int) -> tuple[Any, int]:
        i += len(s[i:]) - len(s[i:].lstrip())
        if s[i] in "[{":
            close, out, i = {"[": "]", "{": "}"}[s[i]], [], i + 1
            while True:
                i += len(s[i:]) - len(s[i:].lstrip())
                if s[i] == close:
                    break
                k, i = self.flow(s, i)
                i += len(s[i:]) - len(s[i:].lstrip())
                if close == "}":
                    v = None
                    if s[i] == ":":
                        v, i = self.flow(s, i + 1)
                    k = (k, v)
                out.append(k)
                i += len(s[i:]) - len(s[i:].lstrip())
                if s[i] == ",":
                    i += 1
            return (dict(out) if close == "}" else out), i + 1
        m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,\[\]{}]*?(?=\s*(?:[,\]}]|:\s|$))").match(s, i)
        return (self.anchors[m[0][1:]] if m[0].startswith("*") else scalar(m[0])), m.end()

    def block(self, style: str, chomp: str, least: int) -> str:
        first = self.rows[self.at - 1][0] + 1
        lines, i = [], first
        while i < len(self.raw) and (not self.raw[i].strip() or len(self.raw[i]) - len(self.raw[i].lstrip()) >= least):
            lines.append(self.raw[i])
            i += 1
        while self.at < len(self.rows) and self.rows[self.at][0] < i:
            self.at += 1
        pad = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        body = [x[pad:].rstrip("\n") for x in lines]
        text = "\n".join(body)
        if style == ">":
            text = re.sub(r"(?<=\S)\n(?=\S)", " ", text)
        text = text.rstrip("\n") if chomp != "+" else text
        return text + ("\n" if not chomp and text else "")


def load_all(text: str) -> list[Any]:
    out = []
    for part in re.split(r"(?m)^---(?=[ \t]|$)", re.sub(r"(?m)^(%.*|\.\.\.[ \t]*)$", "", text)):
        d = _Document(part.split("\n"))
        if d.rows:
            out.append(d.node(0))
            if d.at < len(d.rows):
                raise YamlError(f"unexpected text in line {d.rows[d.at][0] + 1}")
    return out


def load(text: str) -> Any:
    found = load_all(text)
    return found[0] if found else None


def dump(value: Any, indent: int = 0) -> str:
    """Block style; load() gives the value back."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k) if isinstance(k, str) else k}:" + (f"\n{dump(v, indent + 2)}" if isinstance(v, dict | list) and v else f" {dump(v)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-\n{dump(v, indent + 2)}" if isinstance(v, dict | list) and v else f"{pad}- {dump(v)}\n" for v in value)
    return json.dumps(value, ensure_ascii=False)


def to_json_column(text: Column | str) -> Column:
    """Documents of a YAML text as a JSON array; null if it isn't YAML. For whole-text columns, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(load_all(t), ensure_ascii=False)
            except (ValueError, TypeError, AttributeError, IndexError):
                return None

        return s.map(one)

    return run(text if isinstance(text, Column) else F.col(text))
