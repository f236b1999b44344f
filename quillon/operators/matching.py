"""Row patterns: MATCH_RECOGNIZE by regular expressions over one character a row.

A row's character stands for the set of symbols whose conditions it meets, and a symbol for the class of all such characters, so
conditions may overlap and the pattern still means what it says. Symbols without a condition match any row. The expression engine finds the
matches (its own quantifiers, alternatives and anchors hold) and marks where each element ends; nothing is searched for a second time.

A partition is one ordered sequence by definition, so it meets in one task as an array of its rows; partitions are spread by hash.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.lexer import SqlError

FIRST_CHAR = 0x4E00  # of the characters for sets of symbols
MOST_SYMBOLS = 8
START, NEXT, END = "\x01", "\x02", "\x03"


def tests_of(em: Any, m: A.Matched) -> dict[str, str]:
    """Conditions of the symbols as Spark SQL; PREV and NEXT are offsets in the partition's order."""
    part = f"PARTITION BY {em.es(m.partition)} " if m.partition else ""
    over = f"OVER ({part}ORDER BY {', '.join(em.key(k) for k in m.order)})"
    out = {}
    for symbol, cond in m.define:
        def change(x: Any, symbol: str = symbol) -> Any:
            if isinstance(x, A.Name) and len(x.parts) == 2:
                if x.parts[0].upper() != symbol.upper():
                    raise SqlError(f"the condition of {symbol} looks at {x.parts[0]}")
                return A.Name(x.parts[1:])
            if isinstance(x, A.Call) and x.name.upper() in ("PREV", "NEXT"):
                n = em.e(x.args[1]) if len(x.args) > 1 else "1"
                return f"{'lag' if x.name.upper() == 'PREV' else 'lead'}({em.e(x.args[0])}, {n}) {over}"
            if isinstance(x, A.Call) and x.name.upper() in ("FIRST", "LAST", "SUM", "COUNT", "AVG", "MIN", "MAX") and x.over is None:
                raise SqlError(f"{x.name} in a condition of MATCH_RECOGNIZE")
            return x

        out[symbol.upper()] = em.e(A.rewrite(cond, lambda x, change=change: change(x)))
    return out


def elements(pattern: str) -> list[tuple[str, str]] | None:
    """[(symbol, quantifier)] of a flat pattern; None if it has groups or alternatives."""
    found, rest = [], pattern.strip()
    while rest:
        m = re.match(r"([A-Za-z_]\w*)\s*([*+?]\??|\{\d*,?\d*\}\??)?\s*", rest)
        if not m:
            return None
        found.append((m[1].upper(), m[2] or ""))
        rest = rest[m.end() :]
    return found


def regex(pattern: str, symbols: list[str]) -> str:
    """The pattern over characters."""
    def one(name: str) -> str:
        if name not in symbols:
            return "."
        bit = symbols.index(name)
        return "[" + "".join(chr(FIRST_CHAR + m) for m in range(1 << len(symbols)) if m >> bit & 1) + "]"

    flat = elements(pattern)
    if flat is not None:
        return NEXT.join(f"({one(s)}{q})" for s, q in flat)
    if re.search(r"\{-|-\}|PERMUTE", pattern, re.I):
        raise SqlError("exclusions and PERMUTE in a pattern")
    text = re.sub(r"[A-Za-z_]\w*", lambda m: one(m[0].upper()), pattern)
    return "(" + re.sub(r"\s+", "", text.replace("(", "(?:")) + ")"


def match_rows(df: DataFrame, partition: list[str], order: list[str], define: dict[str, str], pattern: str, measures: list[tuple[str, Any]], all_rows: bool = False, skip: str = "PAST LAST ROW", em: Any = None, within: Any = None) -> DataFrame:
    """One row a match (partition columns, match_no and the measures) or all rows of matches with them.

    measures: (name, tree of a parsed expression): A.x, FIRST/LAST/SUM/AVG/MIN/MAX/COUNT(A.x | x | *), MATCH_NUMBER(), CLASSIFIER().
    A span in `within` drops matches whose last order value is later than the first by more than it.
    """
    if skip != "PAST LAST ROW":
        raise SqlError("AFTER MATCH SKIP TO NEXT ROW isn't supported")
    symbols = list(define)
    if len(symbols) > MOST_SYMBOLS:
        raise SqlError(f"more than {MOST_SYMBOLS} conditions")
    names = [f"c{i}" for i in range(len(df.columns))]
    own = {c.lower(): n for c, n in zip(df.columns, names, strict=True)}
    keys = [f"__p{i}" for i in range(len(partition))]
    over = f"OVER ({'PARTITION BY ' + ', '.join(partition) + ' ' if partition else ''}ORDER BY {', '.join(order) or '1'})"
    mask = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(define.values())) or "0"
    chars = F.array(*[F.lit(chr(FIRST_CHAR + m)) for m in range(1 << len(symbols))])
    first_key = re.sub(r"\s+(DESC|ASC)?(\s*NULLS\s+\w+)?$", "", order[0], flags=re.I) if order else "NULL"
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)), *(F.expr(p).alias(k) for p, k in zip(partition, keys, strict=True)), F.expr(f"row_number() {over}").alias("n"), F.expr(f"CAST({mask} AS INT)").alias("m"), F.expr(first_key).alias("t"))
    seq = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "m", "t", *names))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.element_at(chars, r["m"] + 1)), "")
    flat, expression = elements(pattern), regex(pattern, symbols)
    groups = len(flat) if flat is not None else 1
    marked = F.regexp_replace(text, F.lit(expression.replace(NEXT, "")), F.lit(START + NEXT.join(f"${i + 1}" for i in range(groups)) + END))
    parts = F.split(marked, START)
    places = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast("array<struct<a:int,sizes:array<int>>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(F.translate(p, NEXT + END, ""))).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].cast("int").alias("a"), F.transform(F.split(F.substring_index(p, END, 1), NEXT), lambda e: F.length(e)).alias("sizes")))).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda p: F.aggregate(p["sizes"], F.lit(0), lambda a, b: a + b) > 0),
    )
    hits = seq.select(*keys, "rows", F.posexplode(places).alias("no", "place"))
    n = F.aggregate(F.col("place.sizes"), F.lit(0), lambda a, b: a + b)
    part = F.slice("rows", F.col("place.a") + 1, n)
    if flat is not None:
        said = F.flatten(F.zip_with(F.array(*[F.lit(s) for s, _ in flat]), F.col("place.sizes"), lambda s, k: F.array_repeat(s, k)))
    else:  # the first condition that holds
        bits = F.lit(None).cast("string")
        said = F.transform(part, lambda r: F.coalesce(*[F.when(r["m"].bitwiseAND(1 << i) != 0, F.lit(s)) for i, s in enumerate(symbols)], bits))
    hits = hits.select(*keys, (F.col("no") + 1).cast("long").alias("no"), F.zip_with(part, said, lambda r, s: F.struct(r.alias("r"), s.alias("s"))).alias("part"))
    if within is not None:
        span = F.expr(em.e(within))
        hits = hits.where(F.get("part", F.size("part") - 1)["r"]["t"] <= F.get("part", F.lit(0))["r"]["t"] + span)

    def taken(x: Any) -> tuple[Column, Any]:
        """(rows that a measure's argument speaks of, the value in a row)"""
        if isinstance(x, A.Star):
            return (F.filter("part", lambda e: e["s"] == x.table[0].upper()) if x.table else F.col("part")), None
        if not isinstance(x, A.Name):
            raise SqlError("measures are over columns")
        name = own.get(x.parts[-1].lower())
        if name is None:
            raise SqlError(f"no column {x.parts[-1]}")
        symbol = x.parts[0].upper() if len(x.parts) == 2 else None
        some = F.filter("part", lambda e: e["s"] == symbol) if symbol else F.col("part")
        return some, lambda e: e["r"][name]

    def measure(x: Any) -> Column:
        if isinstance(x, A.Bin) and x.op in ("+", "-", "*", "/"):
            a, b = measure(x.left), measure(x.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[x.op]()
        if isinstance(x, A.Lit):
            return F.expr(em.e(x))
        if isinstance(x, A.Name):
            x = A.Call("LAST", [x])
        f = x.name.upper() if isinstance(x, A.Call) else ""
        if f == "MATCH_NUMBER":
            return F.col("no")
        if f == "CLASSIFIER":
            return F.get("part", F.size("part") - 1)["s"]
        if f not in ("FIRST", "LAST", "COUNT", "SUM", "AVG", "MIN", "MAX"):
            raise SqlError(f"a measure of {f or type(x).__name__}")
        some, value = taken(x.args[0])
        if f == "COUNT":
            return F.size(some if value is None else F.filter(some, lambda e: value(e).isNotNull())).cast("long")
        if f in ("FIRST", "LAST"):
            return value(F.try_element_at(some, F.lit(1 if f == "FIRST" else -1)))
        values = F.filter(F.transform(some, value), lambda v: v.isNotNull())
        if f in ("MIN", "MAX"):
            return F.array_min(values) if f == "MIN" else F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(values) > 0, total if f == "SUM" else total / F.size(values))

    labels = [re.sub(r"[`\"]", "", p).split(".")[-1] for p in partition]
    found = [measure(x).alias(name) for name, x in measures]
    if not all_rows:
        return hits.select(*(F.col(k).alias(v) for k, v in zip(keys, labels, strict=True)), F.col("no").alias("match_no"), *found)
    each = hits.select(F.col("no").alias("match_no"), *found, F.explode("part").alias("e"))
    return each.select(*(F.col(f"e.r.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)), "match_no", F.col("e.s").alias("classifier"), *(name for name, _ in measures))
