"""Syntax tree to Spark SQL. What Spark lacks is lowered to what it has; what can't be kept is recorded as a warning."""

from __future__ import annotations

import itertools
import re
from dataclasses import replace
from typing import Any

from . import ast as A
from .dialects import Dialect, dialect
from .functions import rewrite_call
from .lexer import SqlError

LEVEL = {"OR": 1, "XOR": 1, "AND": 2, "||": 6, "|": 4, "^": 4, "&": 4, "<<": 5, ">>": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "DIV": 7}
TYPES = {
    "SIGNED": "BIGINT", "UNSIGNED": "DECIMAL(20,0)", "INTEGER": "INT", "INT4": "INT", "INT8": "BIGINT", "NUMBER": "DECIMAL(38,10)", "NUMERIC": "DECIMAL", "TEXT": "STRING", "CLOB": "STRING", "NVARCHAR": "STRING",
    "NVARCHAR2": "STRING", "VARCHAR": "STRING", "VARCHAR2": "STRING", "CHAR": "STRING", "NCHAR": "STRING", "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DOUBLE PRECISION": "DOUBLE", "FLOAT8": "DOUBLE",
    "FLOAT4": "FLOAT", "REAL": "FLOAT", "BOOL": "BOOLEAN", "BYTEA": "BINARY", "BLOB": "BINARY", "JSON": "STRING", "JSONB": "STRING", "UUID": "STRING", "INT64": "BIGINT", "FLOAT64": "DOUBLE", "BIT": "BOOLEAN", "MONEY": "DECIMAL(19,4)",
    "INT32": "INT", "UINT32": "BIGINT", "UINT64": "DECIMAL(20,0)", "LONGTEXT": "STRING", "TINYINT": "TINYINT",
}


def spark_type(text: str) -> str:
    m = re.match(r"([A-Za-z_0-9 ]+?)\s*(\(.*\))?$", text.strip())
    if not m:
        return text
    base = m[1].upper().strip()
    if base in ("TIMESTAMP WITHOUT TIME ZONE",):
        return "TIMESTAMP_NTZ"
    base = base.replace(" WITH TIME ZONE", "").replace(" VARYING", "").replace(" UNSIGNED", "")
    out = TYPES.get(base, base)
    return out + (m[2] if m[2] and out in ("DECIMAL", "NUMERIC") else "") if "(" not in out or not m[2] else f"DECIMAL{m[2]}"


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`" if not re.fullmatch(r"[A-Za-z_]\w*", name) or name.upper() in RESERVED else name


RESERVED = set("ORDER GROUP FROM SELECT WHERE JOIN ON USING UNION EXCEPT INTERSECT CROSS INNER LEFT RIGHT FULL NATURAL SEMI ANTI WITH".split())


def string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Emitter:
    def __init__(self, source: str | Dialect = "ansi"):
        self.d = dialect(source)
        self.warnings: list[str] = []
        self.ids = itertools.count(1)

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)

    def fresh(self, stem: str) -> str:
        return f"__{stem}{next(self.ids)}"

    # --- expressions

    def e(self, x: Any, level: int = 0) -> str:
        text, own = self._e(x)
        return f"({text})" if own < level else text

    def es(self, xs: list[Any]) -> str:
        return ", ".join(self.e(x) for x in xs)

    def _e(self, x: Any) -> tuple[str, int]:
        """(text, binding level); 9 binds tightest."""
        match x:
            case str():  # Spark SQL that is text already
                return x, 9
            case A.Lit(kind, value, kind2):
                if kind == "string":
                    return string(value), 9
                if kind == "hex":
                    return f"X'{value}'" if self.d.name != "mysql" else f"X'{value.zfill(len(value) + len(value) % 2)}'", 9
                if kind == "bits":
                    return str(int(value or "0", 2)), 9
                if kind == "typed":
                    return f"{kind2} {string(value)}", 9
                return value, 9
            case A.Name(parts):
                u = parts[-1].upper()
                if len(parts) == 1 and u == "ROWNUM":
                    return "row_number() OVER (ORDER BY (SELECT NULL))", 9
                return ".".join(map(quoted, parts)), 9
            case A.Star(table, excluded, _):
                head = ".".join(map(quoted, table)) + "." if table else ""
                return f"{head}*" + (f" EXCEPT ({', '.join(map(quoted, excluded))})" if excluded else ""), 9
            case A.Param(text):
                return text if text[0] in ":?" else f":{text.lstrip('@')}", 9
            case A.Bin():
                return self.binary(x)
            case A.Un(op, value):
                if op == "NOT":
                    return f"NOT {self.e(value, 3)}", 2
                if op == "BINARY":
                    return f"CAST({self.e(value)} AS BINARY)", 9
                if op in ("PRIOR", "CONNECT_BY_ROOT"):
                    raise SqlError(f"{op} outside of a hierarchical query")
                return f"{op}{self.e(value, 8)}", 8
            case A.Is(value, what, negated):
                what = "NULL" if what == "UNKNOWN" else what
                return f"{self.e(value, 4)} IS {'NOT ' * negated}{what}", 3
            case A.Like(op, value, pattern, escape, negated):
                if op == "SIMILAR":
                    if not isinstance(pattern, A.Lit):
                        raise SqlError("SIMILAR TO needs a literal pattern")
                    pattern, op = A.Lit("string", similar(pattern.value)), "RLIKE"
                esc = f" ESCAPE {self.e(escape)}" if escape is not None else ""
                return f"{self.e(value, 4)} {'NOT ' * negated}{op} {self.e(pattern, 4)}{esc}", 3
            case A.Between(value, low, high, negated):
                return f"{self.e(value, 4)} {'NOT ' * negated}BETWEEN {self.e(low, 4)} AND {self.e(high, 4)}", 3
            case A.In(value, items, negated):
                left = self.e(value, 4)
                if isinstance(items, A.Select):
                    return f"{left} {'NOT ' * negated}IN ({self.query(items)})", 3
                if isinstance(items, A.Param):
                    return f"{'NOT ' * negated}array_contains({self.e(items)}, {left})", 3
                if not items:
                    return ("TRUE" if negated else "FALSE"), 9
                return f"{left} {'NOT ' * negated}IN ({self.es(items)})", 3
            case A.Exists(query):
                return f"EXISTS ({self.query(query)})", 9
            case A.Quantified():
                return self.quantified(x)
            case A.Case(operand, whens, otherwise):
                head = f" {self.e(operand)}" if operand is not None else ""
                tail = f" ELSE {self.e(otherwise)}" if otherwise is not None else ""
                return f"CASE{head} {' '.join(f'WHEN {self.e(a)} THEN {self.e(b)}' for a, b in whens)}{tail} END", 9
            case A.Cast(value, kind, safe):
                return f"{'TRY_' * safe}CAST({self.e(value)} AS {spark_type(kind)})", 9
            case A.Interval(value, unit):
                if isinstance(value, A.Lit):
                    return f"INTERVAL {string(value.value) if value.kind == 'string' else value.value} {unit}".strip(), 9
                if unit in ("MONTH", "MONTHS", "YEAR", "YEARS", "QUARTER"):
                    n = {"Y": 12, "Q": 3}.get(unit[0], 1)
                    return f"make_ym_interval(0, CAST({self.e(value)} AS INT){f' * {n}' if n > 1 else ''})", 9
                order = ["DAY", "HOUR", "MINUTE", "SECOND"]
                unit = unit.rstrip("S")
                if unit not in order and unit != "WEEK":
                    raise SqlError(f"INTERVAL of {unit}")
                n = self.e(value, 7)
                args = ["0"] * order.index(unit) + [n] if unit != "WEEK" else [f"{n} * 7"]
                return f"make_dt_interval({', '.join(args)})", 9
            case A.Extract(unit, value):
                if unit.upper() == "EPOCH":
                    return f"unix_timestamp({self.e(value)})", 9
                return f"EXTRACT({unit.upper()} FROM {self.e(value)})", 9
            case A.Row(items):
                return f"({self.es(items)})", 9
            case A.ArrayOf(items):
                return f"array({self.es(items)})", 9
            case A.Item(value, index, to, ranged):
                v = self.e(value, 9)
                if ranged:
                    i = self.e(index) if index is not None else "1"
                    return f"slice({v}, {i}, {self.e(to) if to is not None else f'size({v})'} - {i} + 1)", 9
                return (f"{v}[{self.e(index)}]" if self.d.array_base == 0 else f"try_element_at({v}, {self.e(index)})"), 9
            case A.Collate(value, name):
                if name.upper().endswith("_CI"):
                    name = "UTF8_LCASE"
                elif not name.upper().startswith(("UTF8", "UNICODE")):
                    name = "UTF8_BINARY"
                return f"{self.e(value, 9)} COLLATE {name}", 9
            case A.AtZone(value, zone):
                return f"from_utc_timestamp({self.e(value)}, {self.e(zone)})", 9
            case A.Call():
                return self.call(x), 9
            case A.Select():
                return f"({self.query(x)})", 9
            case A.Key():
                return self.key(x), 0
        raise SqlError(f"cannot write {type(x).__name__}")

    def binary(self, x: A.Bin) -> tuple[str, int]:
        op, l, r = x.op, x.left, x.right
        if op == "XOR":
            return f"CAST({self.e(l)} AS BOOLEAN) <> CAST({self.e(r)} AS BOOLEAN)", 3
        if op == "OVERLAPS":
            (a, b), (c, d) = ([self.e(v) for v in p.items] for p in (l, r))
            return f"least({a}, {b}) < greatest({c}, {d}) AND least({c}, {d}) < greatest({a}, {b})", 2
        if op in ("@>", "<@"):
            a, b = (l, r) if op == "@>" else (r, l)
            return f"size(array_except({self.e(b)}, {self.e(a)})) = 0", 3
        if op == "?":
            return f"coalesce(array_contains(json_object_keys({self.e(l)}), {self.e(r)}), FALSE)", 9
        if op == "?|":
            return f"coalesce(arrays_overlap(json_object_keys({self.e(l)}), {self.e(r)}), FALSE)", 9
        if op == "?&":
            return f"coalesce(size(array_except({self.e(r)}, json_object_keys({self.e(l)}))) = 0, FALSE)", 9
        if op == "&&":
            return f"arrays_overlap({self.e(l)}, {self.e(r)})", 9
        if op in ("->", "->>", "#>", "#>>"):
            if isinstance(l, A.Lit) and l.kind == "word":  # lambda
                return f"{l.value} -> {self.e(r)}", 0
            if not isinstance(r, A.Lit):
                return f"get_json_object({self.e(l)}, concat('$.', {self.e(r)}))", 9
            return f"get_json_object({self.e(json_base(l))}, {string(json_path(x))})", 9
        if op == ".":
            return f"{self.e(l, 9)}.{self.e(r)}", 9
        if op in ("*=", "=*"):
            op = "="
        if op == "/" and self.d.integer_division and all(whole(v) for v in (l, r)):
            op = "DIV"
        if op in ("+", "-") and isinstance(r, A.Lit) and self.d.name in ("oracle", "oracle12", "dameng") and isinstance(l, A.Lit) and l.kind == "typed":
            return f"date_add({self.e(l)}, {'-' * (op == '-')}{self.e(r, 8)})", 9
        if op == "||" and self.d.concat_skips_null and self.d.name in ("oracle", "oracle12", "dameng"):
            return f"concat(coalesce({self.e(l)}, ''), coalesce({self.e(r)}, ''))", 9
        if op in ("=", "<>", "!=") and self.d.no_case:
            return f"{self.e(l, 4)} {op} {self.e(r, 4)} COLLATE UTF8_LCASE", 3
        level = LEVEL.get(op, 3)
        # Both sides of a comparison bind tighter; arithmetic is left-associative.
        return f"{self.e(l, level if level != 3 else 4)} {op} {self.e(r, level + 1)}", level

    def quantified(self, x: A.Quantified) -> tuple[str, int]:
        v, op = self.e(x.value, 4), "=" if x.op == "=" else "<>" if x.op in ("!=", "<>") else x.op
        if not isinstance(x.query, A.Select):
            return f"{'exists' if x.kind == 'ANY' else 'forall'}({self.e(x.query)}, __x -> {v} {op} __x)", 9
        if (op, x.kind) == ("=", "ANY"):
            return f"{v} IN ({self.query(x.query)})", 3
        if (op, x.kind) == ("<>", "ALL"):
            return f"{v} NOT IN ({self.query(x.query)})", 3
        q, n = self.query(x.query), self.fresh("q")
        col = self.fresh("v")
        low = op in (">", ">=")
        pick = "max" if low == (x.kind == "ALL") else "min"
        if op in ("=", "<>"):
            raise SqlError(f"{op} {x.kind} has no lowering")
        # One uncorrelated subquery, read three times; Spark runs equal subqueries once.
        s = f"(SELECT named_struct('n', count(*), 'c', count({col}), 'm', {pick}({col})) FROM ({q}) AS {n}({col}))"
        if x.kind == "ALL":  # true over no rows; unknown if any row is NULL
            return f"CASE WHEN {s}.n = 0 THEN TRUE WHEN NOT ({v} {op} {s}.m) THEN FALSE WHEN {s}.n > {s}.c THEN NULL ELSE {v} {op} {s}.m END", 9
        return f"CASE WHEN {s}.n = 0 THEN FALSE WHEN {v} {op} {s}.m THEN TRUE WHEN {s}.n > {s}.c THEN NULL ELSE {v} {op} {s}.m END", 9

    def key(self, k: A.Key, explicit: bool = True) -> str:
        text = self.e(k.value) + (" DESC" if k.desc else "")
        if k.nulls:
            return f"{text} NULLS {k.nulls}"
        if explicit and self.d.nulls_high:
            return f"{text} NULLS {'FIRST' if k.desc else 'LAST'}"
        return text

    def resolved(self, w: A.Window, named: dict[str, A.Window]) -> A.Window:
        while w.base:
            base = next((v for k, v in named.items() if k.lower() == w.base.lower()), None)
            if base is None:
                raise SqlError(f"unknown window {w.base}")
            w = A.Window(base.base, w.partition or base.partition, w.order or base.order, w.frame or base.frame)
        return w

    def window(self, w: A.Window, named: dict[str, A.Window]) -> str:
        w = self.resolved(w, named)
        parts = []
        if w.partition:
            parts.append(f"PARTITION BY {self.es(w.partition)}")
        if w.order:
            parts.append(f"ORDER BY {', '.join(self.key(k) for k in w.order)}")
        if w.frame:
            parts.append(re.sub(r"INTERVAL\s+'(\d+)\s+(\w+)'", r"INTERVAL \1 \2", w.frame, flags=re.I))
        return " ".join(parts)

    def call(self, c: A.Call) -> str:
        if c.keep:
            side, keys = c.keep
            first = keys[0]
            picks_max = (side == "LAST") != first.desc
            if c.name.upper() in ("MAX", "MIN", "SUM", "AVG", "COUNT") and len(keys) == 1:
                rows = f"collect_list(struct({self.e(first.value)} AS k, {self.e(c.args[0])} AS v))"
                best = f"filter({rows}, x -> x.k = {'array_max' if picks_max else 'array_min'}({rows}).k)"
                f = c.name.upper()
                return {"MAX": f"array_max({best}).v", "MIN": f"array_min(transform({best}, x -> x.v))"}.get(f, f"aggregate({best}, CAST(0 AS DOUBLE), (a, x) -> a + {'1' if f == 'COUNT' else 'x.v'})")
            raise SqlError("KEEP over several keys has no lowering")
        if c.over is not None:
            w = self.resolved(c.over, self.windows)
            if m := re.search(r"\s+EXCLUDE\s+(NO\s+OTHERS|CURRENT\s+ROW|GROUP|TIES)\s*$", w.frame, re.I):
                what = " ".join(m[1].upper().split())
                w = replace(w, frame=w.frame[: m.start()])
                return self.call(replace(c, over=w)) if what == "NO OTHERS" else self.excluding(c, w, what)
        out = rewrite_call(self, c)
        if isinstance(out, A.Call):
            args = self.es(out.args)
            head = f"{out.name}({'DISTINCT ' * out.distinct}{args})"
            if out.within:
                head += f" WITHIN GROUP (ORDER BY {', '.join(self.key(k) for k in out.within)})"
        else:
            head = out
        if c.nulls:
            head += f" {c.nulls} NULLS"
        if c.filter is not None:
            head += f" FILTER (WHERE {self.e(c.filter)})"
        if c.over is not None:
            head += f" OVER ({self.window(c.over, self.windows)})"
        return head

    def excluding(self, c: A.Call, w: A.Window, what: str) -> str:
        """COUNT, SUM and AVG over a frame less the current row, its peers, or its other peers: taken off the frame's own sums."""
        f, plain = c.name.upper(), replace(c, over=None, name="count", nulls="")
        if f not in ("COUNT", "SUM", "AVG") or c.distinct:
            raise SqlError(f"{c.name} over a frame with EXCLUDE has no lowering")
        outside = re.search(r"BETWEEN\s+[1-9]\d*\s+FOLLOWING|AND\s+[1-9]\d*\s+PRECEDING", w.frame, re.I)
        if outside and (what == "CURRENT ROW" or w.frame.upper().startswith("ROWS") is False):
            return self.call(replace(c, over=w))
        if what != "CURRENT ROW" and w.frame.upper().startswith("ROWS"):
            raise SqlError(f"EXCLUDE {what} in a frame of ROWS has no lowering")
        x = c.args[0]
        star = isinstance(x, A.Star)
        one = "1" if star else f"CASE WHEN {self.e(x, 4)} IS NOT NULL THEN 1 ELSE 0 END"
        peers = replace(w, frame="RANGE BETWEEN CURRENT ROW AND CURRENT ROW")
        n_peers, s_peers = self.call(replace(plain, over=peers)), "" if star else self.call(replace(plain, name="sum", over=peers))
        off = {"CURRENT ROW": (one, "" if star else f"coalesce({self.e(x)}, 0)"), "GROUP": (n_peers, f"coalesce({s_peers}, 0)"), "TIES": (f"({n_peers} - {one})", "" if star else f"(coalesce({s_peers}, 0) - coalesce({self.e(x)}, 0))")}[what]
        n = f"({self.call(replace(plain, over=w))} - {off[0]})"
        if f == "COUNT":
            return n
        total = f"({self.call(replace(plain, name='sum', over=w))} - {off[1]})"
        return f"CASE WHEN {n} = 0 THEN NULL ELSE {total}{f' / {n}' if f == 'AVG' else ''} END"

    # --- sources

    windows: dict[str, A.Window] = {}

    def source(self, s: Any) -> str:
        match s:
            case A.Table(parts, alias, sample):
                if parts[-1].upper() == "DUAL" and len(parts) == 1:
                    return f"(SELECT 1 AS dummy) AS {quoted(alias or 'dual')}"
                out = ".".join(map(quoted, parts))
                if s.travel:
                    out += f" {s.travel[0]} AS OF {self.e(s.travel[1])}"
                if s.partition:
                    tests = [f"{quoted(p[0])} = {self.e(p[1])}" if isinstance(p, tuple) else self.partition_test(parts[-1], p) for p in s.partition]
                    out = f"(SELECT * FROM {out} WHERE {(' AND ' if isinstance(s.partition[0], tuple) else ' OR ').join(f'({t})' for t in tests)})"
                    return out + f" AS {quoted(alias or parts[-1])}"
                if sample:
                    out += f" TABLESAMPLE ({sample[0]} PERCENT)" + (f" REPEATABLE ({sample[1]})" if sample[1] else "")
                return out + (f" AS {quoted(alias)}" if alias else "")
            case A.Derived(query, alias, columns, lateral):
                return f"{'LATERAL ' * lateral}({self.query(query)})" + self.named(alias or self.fresh("d"), columns)
            case A.Values(rows, alias, columns):
                return f"(VALUES {', '.join(self.e(r) for r in rows)})" + self.named(alias or self.fresh("v"), columns)
            case A.TableCall(call, alias, columns, ordinality, lateral):
                name = call.name.upper() if isinstance(call, A.Call) else ""
                if name == "UNNEST":
                    arg = self.e(call.args[0])
                    alias = alias or self.fresh("u")
                    columns = columns or [alias]
                    if ordinality:
                        value, place = (columns + ["ordinality"])[:2]
                        return f"LATERAL (SELECT col AS {quoted(value)}, pos + 1 AS {quoted(place)} FROM posexplode({arg}))" + self.named(alias, [])
                    return f"LATERAL explode({arg})" + self.named(alias, columns)
                if name == "GENERATE_SERIES":
                    a, b, *step = [self.e(x) for x in call.args]
                    return f"LATERAL explode(sequence({', '.join([a, b, *step])}))" + self.named(alias or self.fresh("g"), columns or [alias or "generate_series"])
                return f"{'LATERAL ' * lateral}{self.e(call)}" + self.named(alias, columns)
            case A.LateralView(source, call, alias, columns, outer):
                return f"{self.source(source)} LATERAL VIEW {'OUTER ' * outer}{self.e(call)} {quoted(alias)}" + (f" AS {', '.join(map(quoted, columns))}" if columns else "")
            case A.Pivoted(source, kind, body, alias):
                return f"{self.source(source)} {kind} ({body})" + (f" AS {quoted(alias)}" if alias else "")
            case A.Join():
                return self.join(s)
            case A.JsonRows(value, path, fields, alias):
                text = self.e(value)
                list_ = path.removesuffix("[*]")
                found = text if list_ == "$" else f"get_json_object({text}, {string(list_)})"
                # An object where an array may stand is one row.
                items = f"CASE WHEN left(ltrim({found}), 1) = '[' THEN from_json({found}, 'array<string>') WHEN {found} IS NOT NULL THEN array({found}) END"
                cols = [f"CAST(pos + 1 AS BIGINT) AS {quoted(n)}" if k == "ORDINALITY" else f"TRY_CAST(get_json_object(col, {string(p.removeprefix('strict ').removeprefix('lax '))}) AS {spark_type(k)}) AS {quoted(n)}" for n, k, p in fields]
                return f"LATERAL (SELECT {', '.join(cols)} FROM posexplode({items}))" + self.named(alias or self.fresh("j"), [])
            case A.Matched():
                raise SqlError("MATCH_RECOGNIZE runs through Engine.sql, which makes its rows by operators")
        raise SqlError(f"cannot write source {type(s).__name__}")

    #: What the names of partitions stand for: (table, partition) in lower case -> a condition in Spark SQL.
    partitions: dict[tuple[str, str], str] = {}

    def partition_test(self, table: str, name: str) -> str:
        test = self.partitions.get((table.lower(), name.lower()))
        if test is None:
            raise SqlError(f"no condition is known for partition {name} of {table}")
        return test

    def named(self, alias: str, columns: list[str]) -> str:
        if not alias:
            return ""
        return f" AS {quoted(alias)}" + (f"({', '.join(map(quoted, columns))})" if columns else "")

    def join(self, j: A.Join) -> str:
        left, right = self.source(j.left), self.source(j.right)
        if isinstance(j.right, A.Join):
            right = f"({right})"
        if j.kind in ("CROSS APPLY", "OUTER APPLY"):
            lateral = right if right.startswith("LATERAL ") else f"LATERAL {right}"
            return f"{left} {'INNER' if j.kind[0] == 'C' else 'LEFT'} JOIN {lateral} ON TRUE"
        kind = j.kind
        if kind in ("RIGHT SEMI", "RIGHT ANTI"):
            if isinstance(j.left, A.Join):
                raise SqlError(f"{kind} JOIN behind another join")
            left, right, kind = right, left, kind.replace("RIGHT", "LEFT")
        if j.natural:
            kind = f"NATURAL {kind}"
        if kind == "CROSS" and right.startswith("LATERAL "):
            return f"{left}, {right}"
        cond = f" ON {self.e(j.on)}" if j.on is not None else f" USING ({', '.join(map(quoted, j.using))})" if j.using else ""
        return f"{left} {kind} JOIN {right}{cond}"

    # --- queries

    def query(self, q: A.Select) -> str:
        q = lower(self, q)
        saved, self.windows = self.windows, q.windows or self.windows
        out = ""
        if q.ctes:
            recursive = q.recursive or any(refers(c.query, c.name) for c in q.ctes)
            q.ctes = [ordered_walk(self, c) if c.search or c.cycle else c for c in q.ctes]
            out = f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{quoted(c.name)}{'(' + ', '.join(map(quoted, c.columns)) + ')' if c.columns else ''} AS ({self.query(c.query)})" for c in q.ctes) + " "
        out += self.block(q)
        for op, arm in q.sets:
            text = self.query(arm)
            simple = not (arm.order or arm.limit is not None or arm.offset is not None or arm.sets or arm.ctes)
            out += f" {op} {text if simple else f'({text})'}"
        if q.order:
            out += f" ORDER BY {', '.join(self.key(k) for k in q.order)}"
        if q.limit is not None:
            out += f" LIMIT {self.e(q.limit)}"
        if q.offset is not None:
            out += f" OFFSET {self.e(q.offset)}"
        self.windows = saved
        return out

    def block(self, q: A.Select) -> str:
        if q.rows is not None:
            return f"VALUES {', '.join(self.e(r) for r in q.rows)}"
        out = "SELECT " + (f"/*+ {q.hints} */ " if re.match(r"(BROADCAST|MERGE|SHUFFLE|REPARTITION|COALESCE|REBALANCE)", q.hints, re.I) else "") + ("DISTINCT " if q.distinct else "")
        out += ", ".join(self.e(i.value) + (f" AS {quoted(i.alias)}" if i.alias else "") if isinstance(i, A.Column) else self.e(i) for i in q.items)
        if q.source is not None:
            out += f" FROM {self.source(q.source)}"
        if q.where is not None:
            out += f" WHERE {self.e(q.where)}"
        if q.grouping == "ALL":
            out += " GROUP BY GROUPING SETS (())"
        elif q.group:
            keys = self.es(q.group)
            out += f" GROUP BY {q.grouping}({keys})" if q.grouping else f" GROUP BY {keys}"
        if q.having is not None:
            out += f" HAVING {self.e(q.having)}"
        return out


# --- lowering ----------------------------------------------------------------------------------------------------


def lower(em: Emitter, q: A.Select) -> A.Select:
    """The query without what Spark lacks, as far as this block goes."""
    q = replace(q)
    if q.shape:
        if q.shape != "JSON":
            raise SqlError(f"FOR {q.shape} has no lowering")
        inner = replace(q, shape="", ctes=[])
        rows = A.Derived(A.Select(items=[A.Column(A.Call("to_json", [A.Call("collect_list", [A.Call("struct", [A.Star()])])]), "json")], source=A.Derived(inner, em.fresh("q"))), em.fresh("q"))
        q = A.Select(ctes=q.ctes, recursive=q.recursive, items=[A.Star()], source=rows)
    if q.connect is not None:
        q = connect_by(em, q)
    elif q.siblings:
        raise SqlError("ORDER SIBLINGS BY without CONNECT BY")
    if q.distinct_sets:
        q = distinct_sets(em, q)
    if q.preferring:
        q = preferred(em, q)
    if any(isinstance(x, A.Call) and x.over is not None and em.resolved(x.over, q.windows).frame.upper().startswith("GROUPS") for i in q.items for x in A.walk(i)):
        q = group_frames(em, q)
    if em.d.name in ("oracle", "oracle12", "dameng", "sqlserver", "db2"):
        q = old_outer_joins(q)
        q = rownum(q)
    stars = [i for i in q.items if isinstance(i, A.Star) and i.replaced]
    if stars:
        items: list[Any] = []
        for i in q.items:
            if isinstance(i, A.Star) and i.replaced:
                items += [A.Star(i.table, i.excluded + [n for _, n in i.replaced]), *(A.Column(v, n) for v, n in i.replaced)]
            else:
                items.append(i)
        q.items = items
    if q.distinct_on:
        n = em.fresh("rn")
        keys, order = q.distinct_on, [k for k in q.order]
        q.qualify = _and(q.qualify, A.Bin("=", A.Call("row_number", over=A.Window(partition=keys, order=order or [A.Key(k) for k in keys])), A.Lit("number", "1")))
        q.distinct_on = []
        del n
    if q.qualify is not None:
        q = qualify(em, q)
    if q.limit_by:
        n, keys = q.limit_by
        name = em.fresh("rn")
        inner = replace(q, limit_by=None, order=[], limit=None, offset=None, items=[*q.items, A.Column(A.Call("row_number", over=A.Window(partition=keys, order=q.order or [A.Key(k) for k in keys])), name)])
        q = A.Select(items=[A.Star([], [name])], source=A.Derived(inner, em.fresh("q")), where=A.Bin("<=", A.Name([name]), n), order=_outer_keys(q), limit=q.limit, offset=q.offset)
    if q.limit is not None and (q.percent or q.ties):
        name, total = em.fresh("rn"), em.fresh("n")
        f = "rank" if q.ties else "row_number"
        base = replace(q, limit=None, offset=None, percent=False, ties=False, order=[])
        order = q.order or [A.Key(A.Lit("null", "NULL"))]
        if base.sets or base.distinct or base.group:
            base = A.Select(items=[A.Star()], source=A.Derived(base, em.fresh("q")))
        extra = [A.Column(A.Call(f, over=A.Window(order=order)), name), A.Column(A.Call("count", [A.Star()], over=A.Window()), total)]
        most: Any = q.limit if not q.percent else A.Call("ceil", [A.Bin("/", A.Bin("*", A.Name([total]), q.limit), A.Lit("number", "100.0"))])
        ctes, base.ctes = base.ctes, []
        inner = replace(base, items=[*base.items, *extra])
        q = A.Select(ctes=ctes, items=[A.Star([], [name, total])], source=A.Derived(inner, em.fresh("q")), where=A.Bin("<=", A.Name([name]), most), order=_outer_keys(q))
    return q


def distinct_sets(em: Emitter, q: A.Select) -> A.Select:
    """GROUP BY DISTINCT: the grouping sets of all elements together, each once."""
    def sets(x: Any) -> list[list[Any]]:
        items = lambda v: v.items if isinstance(v, A.Row) else [v]
        name = x.name.upper() if isinstance(x, A.Call) else ""
        if name == "GROUPING SETS":
            return [s for v in x.args for s in (sets(v) if isinstance(v, A.Call) and v.name.upper() in ("ROLLUP", "CUBE") else [items(v)])]
        if name == "ROLLUP":
            return [[k for v in x.args[:n] for k in items(v)] for n in range(len(x.args), -1, -1)]
        if name == "CUBE":
            return [[k for v in some for k in items(v)] for n in range(len(x.args), -1, -1) for some in itertools.combinations(x.args, n)]
        return [[x]]

    group = [A.Call(q.grouping, q.group)] if q.grouping in ("ROLLUP", "CUBE") else q.group
    if not any(isinstance(x, A.Call) and x.name.upper() in ("GROUPING SETS", "ROLLUP", "CUBE") for x in group):
        return replace(q, distinct_sets=False)
    found: dict[tuple[str, ...], list[Any]] = {}
    for some in itertools.product(*map(sets, group)):
        keys = {em.e(k): k for part in some for k in part}
        found.setdefault(tuple(sorted(keys)), list(keys.values()))
    return replace(q, distinct_sets=False, grouping="", group=[A.Call("GROUPING SETS", [A.Row(v) for v in found.values()])])


def preferred(em: Emitter, q: A.Select) -> A.Select:
    """PREFERRING HIGH a PLUS LOW b: the rows that no other row of the same block is at least as good as in all and better in one."""
    if not isinstance(q.source, A.Table):
        raise SqlError("PREFERRING over more than a table: give it a view")
    own, other = q.source.alias or q.source.parts[-1], em.fresh("o")

    def of(x: Any, alias: str) -> Any:
        return A.rewrite(x, lambda n: A.Name([alias, n.parts[-1]]) if isinstance(n, A.Name) else n)

    tests, better = [of(c, other) for c in conjuncts(q.where)], None
    for side, v in q.preferring:
        a, b = of(v, other), of(v, own)
        tests.append(A.Bin(">=" if side == "HIGH" else "<=", a, b))
        strict = A.Bin(">" if side == "HIGH" else "<", a, b)
        better = strict if better is None else A.Bin("OR", better, strict)
    rows = A.Select(items=[A.Column(A.Lit("number", "1"))], source=replace(q.source, alias=other), where=joined([*tests, better]))
    return replace(q, preferring=[], where=_and(q.where, A.Un("NOT", A.Exists(rows))))


def group_frames(em: Emitter, q: A.Select) -> A.Select:
    """GROUPS frames count peer groups: a dense rank below, and a RANGE frame over it."""
    sources = [x for x in A.walk(q.source) if isinstance(x, A.Table | A.Derived)]
    if q.group or q.distinct or len(sources) != 1 or q.source is not sources[0]:
        raise SqlError("a frame of GROUPS needs a block over one table or query")
    extra: list[A.Column] = []

    def change(x: Any) -> Any:
        if isinstance(x, A.Call) and x.over is not None:
            w = em.resolved(x.over, q.windows)
            if w.frame.upper().startswith("GROUPS"):
                name = em.fresh("g")
                extra.append(A.Column(A.Call("dense_rank", over=A.Window(partition=w.partition, order=w.order)), name))
                return replace(x, over=A.Window(partition=w.partition, order=[A.Key(A.Name([name]))], frame="RANGE" + w.frame[6:]))
        return x

    items = A.rewrite(q.items, change)
    hidden = [c.alias for c in extra]
    items = [replace(i, excluded=[*i.excluded, *hidden]) if isinstance(i, A.Star) else i for i in items]
    alias = getattr(q.source, "alias", "") or (q.source.parts[-1] if isinstance(q.source, A.Table) else em.fresh("q"))
    return replace(q, items=items, where=None, source=A.Derived(A.Select(items=[A.Star(), *extra], source=q.source, where=q.where), alias))


def ordered_walk(em: Emitter, c: A.Cte) -> A.Cte:
    """SEARCH and CYCLE of a recursive query, as columns that it carries along."""
    if len(c.query.sets) != 1 or c.query.sets[0][0] != "UNION ALL":
        raise SqlError("SEARCH and CYCLE need one UNION ALL")
    first, (op, more) = replace(c.query, sets=[], ctes=[]), c.query.sets[0]
    names = c.columns or [i.alias or (i.value.parts[-1] if isinstance(i.value, A.Name) else "") for i in first.items]
    place = {n.lower(): k for k, n in enumerate(names)}
    own = next((t.alias or t.parts[-1] for t in A.walk(more.source) if isinstance(t, A.Table) and t.parts[-1].lower() == c.name.lower()), None)
    if own is None or any(isinstance(i, A.Star) for i in [*first.items, *more.items]):
        raise SqlError("SEARCH and CYCLE need named columns and a recursive arm")

    def values(arm: A.Select, keys: list[str]) -> str:
        for k in keys:
            if k.lower() not in place:
                raise SqlError(f"{k} isn't a column of {c.name}")
        return ", ".join(f"'k{j}', {em.e(arm.items[place[k.lower()]].value)}" for j, k in enumerate(keys))

    added: list[str] = []
    head, tail, where = list(first.items), list(more.items), more.where
    if c.search:
        kind, keys, name = c.search
        if kind == "DEPTH":
            head.append(A.Column(f"array(named_struct({values(first, keys)}))", name))
            tail.append(A.Column(f"array_append({quoted(own)}.{quoted(name)}, named_struct({values(more, keys)}))", name))
        else:
            head.append(A.Column(f"named_struct('depth', 1, {values(first, keys)})", name))
            tail.append(A.Column(f"named_struct('depth', {quoted(own)}.{quoted(name)}.depth + 1, {values(more, keys)})", name))
        added.append(name)
    if c.cycle:
        keys, flag, path = c.cycle
        path = path or em.fresh("path")
        head += [A.Column("FALSE", flag), A.Column(f"array(named_struct({values(first, keys)}))", path)]
        seen = f"{quoted(own)}.{quoted(path)}"
        tail += [A.Column(f"array_contains({seen}, named_struct({values(more, keys)}))", flag), A.Column(f"array_append({seen}, named_struct({values(more, keys)}))", path)]
        where = _and(where, A.Un("NOT", A.Name([own, flag])))
        added += [flag, path]
    return A.Cte(c.name, [*names, *added], replace(first, items=head, sets=[(op, replace(more, items=tail, where=where))], ctes=c.query.ctes))


def _and(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else A.Bin("AND", a, b)


def _outer_keys(q: A.Select) -> list[A.Key]:
    """Order keys that hold outside of the block: aliases, places and bare columns lose their table."""
    return [replace(k, value=A.Name(k.value.parts[-1:]) if isinstance(k.value, A.Name) else k.value) for k in q.order if isinstance(k.value, A.Name | A.Lit)]


def qualify(em: Emitter, q: A.Select) -> A.Select:
    """Window calls of the condition become columns of an inner query; the condition stays outside."""
    found: list[tuple[A.Call, str]] = []
    aliases = {i.alias.lower(): i.value for i in q.items if isinstance(i, A.Column) and i.alias}

    def change(x: Any) -> Any:
        if isinstance(x, A.Call) and x.over is not None:
            found.append((x, em.fresh("w")))
            return A.Name([found[-1][1]])
        return x

    cond = A.rewrite(q.qualify, change)

    def outside(x: Any) -> Any:
        if isinstance(x, A.Name) and len(x.parts) == 1 and x.parts[0].lower() not in aliases and not x.parts[0].startswith("__"):
            found.append((x, em.fresh("c")))
            return A.Name([found[-1][1]])
        return A.Name(x.parts[-1:]) if isinstance(x, A.Name) else x

    cond = A.rewrite(cond, outside)
    hidden = [n for _, n in found]
    inner = replace(q, qualify=None, ctes=[], order=[], limit=None, offset=None, items=[*q.items, *(A.Column(x, n) for x, n in found)])
    if q.distinct:
        inner.distinct = False
    out = A.Select(ctes=q.ctes, recursive=q.recursive, distinct=q.distinct, items=[A.Star([], hidden)], source=A.Derived(inner, em.fresh("q")), where=cond, order=_outer_keys(q), limit=q.limit, offset=q.offset, percent=q.percent, ties=q.ties)
    return out


def rownum(q: A.Select) -> A.Select:
    """WHERE ROWNUM <= n is a limit taken before the ordering of the same block."""
    rest, n = [], None
    for c in conjuncts(q.where):
        if isinstance(c, A.Bin) and isinstance(c.left, A.Name) and c.left.parts[-1].upper() == "ROWNUM" and c.op in ("<=", "<", "=") and isinstance(c.right, A.Lit):
            n = int(c.right.value) - (c.op == "<")
        else:
            rest.append(c)
    if n is None:
        return q
    q = replace(q, where=joined(rest))
    if q.order or q.group or q.distinct:
        inner = A.Select(items=[A.Star()], source=q.source, where=q.where, limit=A.Lit("number", str(n)))
        return replace(q, source=A.Derived(inner, next((t.alias or t.parts[-1] for t in A.walk(q.source) if isinstance(t, A.Table)), "q")), where=None)
    return replace(q, limit=A.Lit("number", str(n)))


def conjuncts(x: Any) -> list[Any]:
    if x is None:
        return []
    return [*conjuncts(x.left), *conjuncts(x.right)] if isinstance(x, A.Bin) and x.op == "AND" else [x]


def joined(xs: list[Any]) -> Any:
    out = None
    for x in xs:
        out = _and(out, x)
    return out


def old_outer_joins(q: A.Select) -> A.Select:
    """(+), *= and =* in WHERE become real outer joins."""
    def marked(c: Any) -> bool:
        return any(isinstance(x, A.Name) and x.outer for x in A.walk(c)) or isinstance(c, A.Bin) and c.op in ("*=", "=*")

    conds = conjuncts(q.where)
    moved = [c for c in conds if marked(c)]
    if not moved:
        return q
    tables: list[Any] = []

    def flat(s: Any) -> None:
        if isinstance(s, A.Join) and s.kind == "CROSS":
            flat(s.left)
            flat(s.right)
        else:
            tables.append(s)

    flat(q.source)
    alias = lambda t: (t.alias or t.parts[-1]).lower() if isinstance(t, A.Table) else getattr(t, "alias", "").lower()
    optional: dict[str, list[Any]] = {}
    for c in moved:
        if isinstance(c, A.Bin) and c.op in ("*=", "=*"):
            inner = c.right if c.op == "*=" else c.left
            name = inner.parts[0].lower()
            c = A.Bin("=", c.left, c.right)
        else:
            name = next(x.parts[0].lower() for x in A.walk(c) if isinstance(x, A.Name) and x.outer)
        optional.setdefault(name, []).append(A.rewrite(c, lambda x: replace(x, outer=False) if isinstance(x, A.Name) else x))
    kept = [t for t in tables if alias(t) not in optional]
    source = kept[0]
    for t in kept[1:]:
        source = A.Join("CROSS", source, t)
    for t in tables:
        if alias(t) in optional:
            source = A.Join("LEFT", source, t, joined(optional[alias(t)]))
    return replace(q, source=source, where=joined([c for c in conds if not marked(c)]))


def connect_by(em: Emitter, q: A.Select) -> A.Select:
    """A recursive query with level, path and root. NOCYCLE skips rows that are in their own path."""
    if not isinstance(q.source, A.Table):
        raise SqlError("CONNECT BY over more than a table: give it a view")
    t = q.source.alias or q.source.parts[-1]
    walk_, level, path = em.fresh("walk"), "level", "__path"
    roots = {em.e(x.value): em.fresh("root") for i in q.items for x in A.walk(i) if isinstance(x, A.Un) and x.op == "CONNECT_BY_ROOT"}

    def bare(x: Any) -> Any:
        return A.Name(x.parts[-1:]) if isinstance(x, A.Name) else x

    def side(x: Any) -> Any:
        """PRIOR columns come from the walk, others from the table."""
        if isinstance(x, A.Un) and x.op == "PRIOR":
            return A.Name(["p", x.value.parts[-1]])
        return x

    cond = A.rewrite(q.connect, side)
    cond = A.rewrite(cond, lambda x: A.Name(["c", x.parts[-1]]) if isinstance(x, A.Name) and x.parts[0] != "p" else x)
    prior = next((x.value for x in A.walk(q.connect) if isinstance(x, A.Un) and x.op == "PRIOR"), None)
    key = prior.parts[-1] if prior is not None else None
    if key is None:
        raise SqlError("CONNECT BY without PRIOR")
    mark = f"CAST({quoted(key)} AS STRING)"
    src = em.source(replace(q.source, alias=""))
    siblings: list[str] = []
    if q.siblings:  # a path of places among siblings: comparing such paths is the walk's own order
        keys = ", ".join(em.key(replace(k, value=A.rewrite(k.value, bare))) for k in q.order)
        side_of = next((c for c in conjuncts(q.connect) if isinstance(c, A.Bin) and c.op == "=" and any(isinstance(v, A.Un) and v.op == "PRIOR" for v in (c.left, c.right))), None)
        if side_of is None:
            raise SqlError("ORDER SIBLINGS BY needs PRIOR a = b")
        parent = em.e(A.rewrite(side_of.right if isinstance(side_of.left, A.Un) else side_of.left, bare))
        src = f"(SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY {keys}) AS __sibling FROM {src})"
        siblings = ["__sibling", "__siblings"]
    extra = "".join(f", {em.e(A.rewrite(A.Name([r.split('.')[-1]]), bare))} AS {n}" for r, n in roots.items())
    start = f" WHERE {em.e(A.rewrite(q.start, bare))}" if q.start is not None else ""
    more = "".join(f", p.{n}" for n in roots.values())
    guard = f" AND NOT array_contains(p.{path}, CAST(c.{quoted(key)} AS STRING))" if q.nocycle else ""
    # SYS_CONNECT_BY_PATH carries an array of its argument's values for each call.
    carried = {em.e(x.args[0]): (em.fresh("path"), x.args[0]) for i in [*q.items, *q.order] for x in A.walk(i) if isinstance(x, A.Call) and x.name.upper() == "SYS_CONNECT_BY_PATH"}
    for n, arg in carried.values():
        extra += f", array(CAST({em.e(A.rewrite(arg, bare))} AS STRING)) AS {n}"
        more += f", array_append(p.{n}, CAST({em.e(A.rewrite(arg, lambda x: A.Name(['c', x.parts[-1]]) if isinstance(x, A.Name) else x))} AS STRING))"
    if siblings:
        extra += f", array(row_number() OVER (ORDER BY {keys})) AS __siblings"
        more += ", array_append(p.__siblings, c.__sibling)"
    body = f"SELECT *, 1 AS {level}, array({mark}) AS {path}{extra} FROM {src}{start} UNION ALL SELECT c.*, p.{level} + 1, array_append(p.{path}, CAST(c.{quoted(key)} AS STRING)){more} FROM {src} c JOIN {walk_} p ON {em.e(cond)}{guard}"
    def out(x: Any) -> Any:
        if isinstance(x, A.Un) and x.op == "CONNECT_BY_ROOT":
            return A.Name([roots[em.e(x.value)]])
        if isinstance(x, A.Name) and x.parts[-1].upper() == "LEVEL":
            return A.Name([level])
        if isinstance(x, A.Call) and x.name.upper() == "SYS_CONNECT_BY_PATH":
            return A.Call("concat", [x.args[1], A.Call("array_join", [A.Name([carried[em.e(x.args[0])][0]]), x.args[1]])])
        return x

    order = [A.Key(A.Name(["__siblings"]))] if siblings else A.rewrite(q.order, out)
    hide = [path, *siblings, *roots.values(), *(n for n, _ in carried.values()), *([level] if any(isinstance(i, A.Star) for i in q.items) else [])]
    items = [A.Star([], hide) if isinstance(i, A.Star) else i for i in A.rewrite(q.items, out)]
    return replace(q, ctes=[*q.ctes, A.Cte(walk_, [], RawQuery(body))], recursive=True, items=items, source=A.Table([walk_], t), where=A.rewrite(q.where, out), order=order, siblings=False, connect=None, start=None)


class RawQuery(A.Select):
    """A query that is text already."""

    def __init__(self, text: str):
        super().__init__()
        self.text = text


_query = Emitter.query


def _query_or_raw(self: Emitter, q: A.Select) -> str:
    return q.text if isinstance(q, RawQuery) else _query(self, q)


Emitter.query = _query_or_raw


def refers(q: Any, name: str) -> bool:
    return isinstance(q, A.Select) and any(isinstance(x, A.Table) and x.parts[-1].lower() == name.lower() for x in A.walk(q))


def whole(x: Any) -> bool:
    return isinstance(x, A.Lit) and x.kind == "number" and x.value.isdigit() or isinstance(x, A.Call) and x.name.upper() in ("COUNT", "LENGTH", "YEAR", "MONTH", "DAY") or isinstance(x, A.Extract)


def json_base(x: Any) -> Any:
    return json_base(x.left) if isinstance(x, A.Bin) and x.op in ("->", "->>") and isinstance(x.right, A.Lit) else x


def json_path(x: Any) -> str:
    """$.a.b[1] of a chain of arrows."""
    if not (isinstance(x, A.Bin) and x.op in ("->", "->>", "#>", "#>>") and isinstance(x.right, A.Lit)):
        return "$"
    v = x.right.value
    if x.op in ("#>", "#>>"):
        return json_path(x.left) + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in v.strip("{}").split(","))
    if x.right.kind == "number":
        return json_path(x.left) + f"[{v}]"
    return json_path(x.left) + (v[1:] if v.startswith("$") else f".{v}")


def similar(p: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    return "^(?:" + "".join({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$", "\\": "\\\\"}.get(c, c) for c in p) + ")$"


def statement(em: Emitter, s: A.Statement) -> str:
    """The text of a statement, from its tree."""
    name = ".".join(map(quoted, s.target))
    sets = lambda pairs: ", ".join(f"{em.e(a)} = {em.e(b)}" if not isinstance(a, A.Star) else "*" for a, b in pairs)
    tail = f" WHERE {em.e(s.where)}" if s.where is not None else ""
    if s.returning or s.limit is not None or s.conflict is not None:
        raise SqlError(f"this {s.kind} needs the state of its table: run it by Engine.sql")
    if s.kind == "INSERT":
        cols = f" ({', '.join(map(quoted, s.columns))})" if s.columns else ""
        rows = em.query(s.query) if s.query is not None else f"VALUES {', '.join(em.e(r) for r in s.rows)}"
        part = f" PARTITION ({s.options['partition']})" if "partition" in s.options else ""
        return f"INSERT {'OVERWRITE' if s.overwrite else 'INTO'} {name}{part}{cols} {rows}"
    if s.kind == "UPDATE":
        if not isinstance(s.source, A.Table):
            raise SqlError("UPDATE over a join needs the state of its table: run it by Engine.sql")
        return f"UPDATE {em.source(s.source)} SET {sets(s.assignments)}{tail}"
    if s.kind == "DELETE":
        if not isinstance(s.source, A.Table):
            raise SqlError("DELETE over a join needs the state of its table: run it by Engine.sql")
        return f"DELETE FROM {em.source(s.source)}{tail}"
    if s.kind == "MERGE":
        out = f"MERGE INTO {em.source(s.source.left)} USING {em.source(s.source.right)} ON {em.e(s.on)}"
        for a in s.actions:
            kind = {"BY SOURCE": "NOT MATCHED BY SOURCE"}.get(a.kind, a.kind)
            out += f" WHEN {kind}" + (f" AND {em.e(a.when)}" if a.when is not None else "") + " THEN "
            cols = f" ({', '.join(map(quoted, a.columns))})" if a.columns else ""
            out += "DELETE" if a.delete else f"UPDATE SET {sets(a.assignments)}" if a.assignments else f"INSERT{cols} VALUES ({em.es(a.values)})" if a.columns else "INSERT *"
        return out
    if s.kind == "DDL" and s.query is not None:
        return f"{s.options['head']} {em.query(s.query)}"
    if s.kind in ("INSERT ALL", "LOAD", "COPY"):
        raise SqlError(f"{s.kind} needs the state of its tables: run it by Engine.sql")
    em.warn(f"{s.kind} {s.verb} is passed on as written")
    return s.text


def to_spark(tree: Any, source: str | Dialect = "ansi", partitions: dict[tuple[str, str], str] | None = None) -> tuple[str, list[str]]:
    """(Spark SQL, warnings) of a query or a statement."""
    em = Emitter(source)
    em.partitions = partitions or {}
    text = statement(em, tree) if isinstance(tree, A.Statement) else em.query(tree)
    return text, em.warnings
