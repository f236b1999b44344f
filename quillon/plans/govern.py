"""Governance of queries: what a statement touches, whether it may run, and changes to its tree."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from . import ast as A
from .dialects import Dialect
from .emit import Emitter, RawQuery, conjuncts, quoted
from .lexer import SqlError
from .parser import Parser, parse, parse_all, parse_expr

# --- reports -----------------------------------------------------------------------------------------------------


@dataclass
class Stat:
    tables: dict[str, set[str]] = field(default_factory=dict)  # table -> SELECT, INSERT, UPDATE, DELETE, …
    columns: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    conditions: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    read_only: bool = True

    def rows(self) -> list[tuple[str, str, str]]:
        out = [("table", t, k) for t, kinds in self.tables.items() for k in kinds]
        out += [("column", c, "") for c in self.columns] + [("function", f, "") for f in self.functions]
        return sorted(out + [("condition", c, "") for c in self.conditions] + [("group", c, "") for c in self.group_by] + [("order", c, "") for c in self.order_by])


def stat(sql: str, d: str | Dialect = "mysql") -> Stat:
    """Tables by access, columns (aliases too), conditions, keys. Names of common table expressions aren't tables."""
    out, em = Stat(), Emitter(d)
    for s in parse_all(sql, d):
        ctes = {c.name.lower() for x in A.walk(s) if isinstance(x, A.Select) for c in x.ctes}
        for x in A.walk(s):
            if isinstance(x, A.Table) and x.parts[-1].lower() not in ctes and x.parts[-1].lower() != "dual":
                out.tables.setdefault(".".join(x.parts), set()).add("SELECT")
            elif isinstance(x, A.Name):
                out.columns.add(x.parts[-1])
            elif isinstance(x, A.Column) and x.alias:
                out.columns.add(x.alias)
            elif isinstance(x, A.Call):
                out.functions.add(x.name.upper())
            elif isinstance(x, A.Join) and x.on is not None:
                out.conditions.append(em.e(x.on))
            if isinstance(x, A.Select):
                out.conditions += [em.e(c) for c in (x.where, x.having) if c is not None]
                out.group_by += [em.e(k) for k in x.group]
                out.order_by += [em.e(k.value) for k in x.order]
        if isinstance(s, A.Statement):
            if s.target:
                out.tables.setdefault(".".join(s.target), set()).add(s.kind)
                if s.kind in ("UPDATE", "DELETE", "MERGE"):
                    out.tables[".".join(s.target)].discard("SELECT")
            out.conditions += [em.e(c) for c in (s.where, s.on) if c is not None]
            for a in s.actions:
                if a.target:
                    out.tables.setdefault(".".join(a.target), set()).add("INSERT")
        if isinstance(s, A.Select) and s.into:
            out.tables.setdefault(s.into, set()).add("INSERT")
    out.read_only = is_read_only(sql, d)
    return out


def tables(sql: str, d: str | Dialect = "mysql") -> list[str]:
    return sorted(stat(sql, d).tables)


def is_read_only(sql: str, d: str | Dialect = "mysql") -> bool:
    """No write, no lock, no SELECT … INTO, in any statement."""
    for s in parse_all(sql, d):
        if isinstance(s, A.Statement) and s.kind not in ("SHOW", "EXPLAIN", "DESC", "DESCRIBE", "OTHER"):
            return False
        if isinstance(s, A.Statement) and s.kind == "OTHER" and s.verb:
            return False
        if any(isinstance(x, A.Select) and (x.locked or x.into) for x in A.walk(s)):
            return False
    return True


# Fixed values, an interface of rule codes and names that must be as they are: the codes that wall() gives (parse-error, multi-statement,
# comment-bypass, select-only, deny-ddl, delete-without-where, update-without-where, always-true-condition, into-outfile, deny-union,
# sleep-function, dangerous-function, information-schema, too-many-tables, deny-table, allow-table, missing-where-column), and functions
# and procedures that wait, read files or reach the system.
SLEEPERS = {"SLEEP", "BENCHMARK", "PG_SLEEP", "WAITFOR"}
DANGEROUS = SLEEPERS | {"LOAD_FILE", "XP_CMDSHELL", "SYS_EVAL", "SYS_EXEC", "EXTRACTVALUE", "UPDATEXML", "JAVA_METHOD", "REFLECT", "SP_OACREATE", "SP_OAMETHOD", "XP_REGREAD", "XP_DIRTREE", "LO_IMPORT", "LO_EXPORT", "PG_READ_FILE", "DBMS_LOCK.SLEEP"}


@dataclass
class WallConfig:
    multi_statement: bool = False  # allowed?
    comments: bool = False
    always_true: bool = False
    update_without_where: bool = False
    delete_without_where: bool = False
    ddl: bool = False
    dangerous_functions: bool = False
    outfile: bool = False
    union: bool = True
    information_schema: bool = True
    select_only: bool = False
    max_tables: int = 0
    deny_tables: Iterable[str] = ()
    allow_tables: Iterable[str] = ()
    required_columns: dict[str, str] = field(default_factory=dict)  # table -> column that WHERE must test
    rules: list[Callable[[Any], str | None]] = field(default_factory=list)


def wall(sql: str, d: str | Dialect = "mysql", config: WallConfig | None = None) -> list[str]:
    """Codes of broken rules; empty: the text may run."""
    c, out = config or WallConfig(), []
    try:
        p = Parser(sql, d)
        found = parse_all(sql, d)
    except SqlError:
        return ["parse-error"]
    if len(found) > 1 and not c.multi_statement:
        out.append("multi-statement")
    if p.comments and not c.comments:
        out.append("comment-bypass")
    for s in found:
        statement = s if isinstance(s, A.Statement) else None
        if c.select_only and statement:
            out.append("select-only")
        if statement and (statement.kind == "DDL" or statement.verb in ("GRANT", "REVOKE", "DENY")) and not c.ddl:
            out.append("deny-ddl")
        if statement and statement.kind == "DELETE" and statement.where is None and not c.delete_without_where:
            out.append("delete-without-where")
        if statement and statement.kind == "MERGE" and not c.delete_without_where and any(a.delete and a.when is None and a.kind == "BY SOURCE" for a in statement.actions):
            out.append("delete-without-where")
        if statement and statement.kind == "UPDATE" and statement.where is None and not c.update_without_where:
            out.append("update-without-where")
        conds = [x for n in A.walk(s) for x in ((n.where, n.having) if isinstance(n, A.Select) else (n.where, n.on) if isinstance(n, A.Statement) else (n.on,) if isinstance(n, A.Join) and n.kind != "CROSS" else ()) if x is not None]
        if not c.always_true and any(always_true(x) for x in conds):
            out.append("always-true-condition")
        selects = [x for x in A.walk(s) if isinstance(x, A.Select)]
        if not c.outfile and any(x.into.startswith("OUTFILE") for x in selects):
            out.append("into-outfile")
        if not c.union and any(op.startswith("UNION") for x in selects for op, _ in x.sets):
            out.append("deny-union")
        calls = {x.name.upper().split(".")[-1] for x in A.walk(s) if isinstance(x, A.Call)}
        if statement and statement.kind in ("CALL", "OTHER", "SET", "DDL"):  # what a tree doesn't hold is looked for in the text
            calls |= {w for w in DANGEROUS if re.search(rf"\b{re.escape(w)}\b", statement.text, re.I)}
        if not c.dangerous_functions and calls & SLEEPERS:
            out.append("sleep-function")
        if not c.dangerous_functions and calls & (DANGEROUS - SLEEPERS):
            out.append("dangerous-function")
        names = [x.parts for x in A.walk(s) if isinstance(x, A.Table)] + ([statement.target] if statement and statement.target else [])
        if not c.information_schema and any(n[0].lower() in ("information_schema", "sys", "pg_catalog") for n in names):
            out.append("information-schema")
        short = {n[-1].lower() for n in names}
        if c.max_tables and len(short) > c.max_tables:
            out.append("too-many-tables")
        if short & {t.lower() for t in c.deny_tables}:
            out.append("deny-table")
        allowed = {t.lower() for t in c.allow_tables}
        if allowed and short - allowed:
            out.append("allow-table")
        tested = {x.parts[-1].lower() for w in conds for x in A.walk(w) if isinstance(x, A.Name)}
        if any(t.lower() in short and col.lower() not in tested for t, col in c.required_columns.items()):
            out.append("missing-where-column")
        out += [code for r in c.rules if (code := r(s))]
    return list(dict.fromkeys(out))


def always_true(x: Any) -> bool:
    if isinstance(x, A.Bin) and x.op == "OR":
        return always_true(x.left) or always_true(x.right)
    if isinstance(x, A.Bin) and x.op == "AND":
        return always_true(x.left) and always_true(x.right)
    if isinstance(x, A.Like) and isinstance(x.pattern, A.Lit) and not x.negated:
        return bool(re.fullmatch(r"%[%_]*", x.pattern.value))
    if isinstance(x, A.Bin) and x.op in ("=", "<=", ">=", "<=>") and isinstance(x.left, A.Name) and x.left == x.right:
        return True
    return evaluate(x) is True


UNKNOWN = object()


def evaluate(x: Any) -> Any:
    """The value of an expression of literals; UNKNOWN if it needs a row. Strings compare without case; x / 0 is NULL."""
    if isinstance(x, A.Lit):
        if x.kind == "number":
            return float(x.value) if re.search(r"[.eE]", x.value) else int(x.value)
        return {"null": None, "bool": x.value == "TRUE", "string": x.value}.get(x.kind, UNKNOWN)
    if isinstance(x, A.Un):
        v = evaluate(x.value)
        if v is UNKNOWN or v is None:
            return v
        return {"-": lambda: -v, "+": lambda: v, "NOT": lambda: not v}.get(x.op, lambda: UNKNOWN)()
    if isinstance(x, A.Is):
        v = evaluate(x.value)
        return UNKNOWN if v is UNKNOWN else ({"NULL": v is None, "TRUE": v is True, "FALSE": v is False}[x.what] != x.negated)
    if isinstance(x, A.In) and isinstance(x.items, list):
        v, items = evaluate(x.value), [evaluate(i) for i in x.items]
        return UNKNOWN if v is UNKNOWN or UNKNOWN in items else (v in items) != x.negated
    if isinstance(x, A.Between):
        v = [evaluate(i) for i in (x.value, x.low, x.high)]
        return UNKNOWN if any(i is UNKNOWN or i is None for i in v) else (v[1] <= v[0] <= v[2]) != x.negated
    if isinstance(x, A.Bin):
        a, b = evaluate(x.left), evaluate(x.right)
        if a is UNKNOWN or b is UNKNOWN:
            return UNKNOWN
        if a is None or b is None:
            return (a is b) if x.op == "<=>" else None
        if isinstance(a, str) and isinstance(b, str):
            a, b = a.lower(), b.lower()
        try:
            return {
                "=": lambda: a == b, "<=>": lambda: a == b, "<>": lambda: a != b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "AND": lambda: a and b, "OR": lambda: a or b,
                "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if b else None, "%": lambda: math.fmod(a, b) if b else None,
            }.get(x.op, lambda: UNKNOWN)()
        except TypeError:
            return UNKNOWN
    return UNKNOWN


# --- changes -----------------------------------------------------------------------------------------------------


def and_where(tree: A.Select, condition: str, d: str | Dialect = "mysql") -> A.Select:
    """On the first arm only."""
    return replace(tree, where=_and(tree.where, parse_expr(condition, d)))


def _and(a: Any, b: Any) -> Any:
    return b if a is None else A.Bin("AND", a, b)


def inject(tree: Any, column: str, value: Any, only: Iterable[str] | None = None) -> Any:
    """column = value for every table at any depth, by the table's alias, in WHERE. On the nullable side of an outer join
    the test goes to the ON condition, so the join stays an outer one; under PIVOT and MATCH_RECOGNIZE it goes to the scan.

    Writes: UPDATE and DELETE get it in WHERE, MERGE in ON; what is inserted gets the column. What can't be governed is refused.
    """
    wanted = {t.lower() for t in only} if only is not None else None
    ctes = {c.name.lower() for x in A.walk(tree) if isinstance(x, A.Select) for c in x.ctes}
    lit = A.Lit("number", str(value)) if isinstance(value, int) else A.Lit("string", str(value))

    def asked(name: str) -> bool:
        return wanted is None or name.lower() in wanted

    def hit(t: Any) -> bool:
        return isinstance(t, A.Table) and t.parts[-1].lower() not in ctes | {"dual"} and asked(t.parts[-1])

    def test(t: A.Table) -> Any:
        return A.Bin("=", A.Name([t.alias or t.parts[-1], column]), lit)

    def scan(t: A.Table) -> A.Derived:
        return A.Derived(A.Select(items=[A.Star()], source=t, where=test(t)), t.alias or t.parts[-1])

    def scans(source: Any, but: Any = None) -> Any:
        """The source with the test at every scan, one table excepted. Queries inside are governed already."""
        if hit(source) and source is not but:
            return scan(source)
        if isinstance(source, A.Join):
            return replace(source, left=scans(source.left, but), right=scans(source.right, but))
        if isinstance(source, A.LateralView | A.Pivoted | A.Matched):
            return replace(source, source=scans(source.source, but))
        if source is None or isinstance(source, A.Table | A.Derived | A.Values | A.TableCall | A.JsonRows):
            return source
        raise SqlError(f"a tenant filter can't be put into {type(source).__name__}")

    def visit(s: Any, nullable: bool) -> tuple[Any, list[Any]]:
        """(source, tests for WHERE)"""
        if hit(s):
            return s, [] if nullable else [test(s)]
        if isinstance(s, A.LateralView):
            source, tests = visit(s.source, nullable)
            return replace(s, source=source), tests
        if isinstance(s, A.Join):
            left, a = visit(s.left, nullable or s.kind in ("RIGHT", "FULL"))
            right, b = visit(s.right, nullable or s.kind in ("LEFT", "FULL"))
            on = s.on
            if s.kind == "LEFT" and on is not None:
                for t in (x for x in bare(s.right)):
                    on = _and(on, test(t))
            elif s.kind == "RIGHT" and on is not None:
                for t in (x for x in bare(s.left)):
                    on = _and(on, test(t))
            elif s.kind == "FULL" or s.kind in ("LEFT", "RIGHT"):  # USING and NATURAL have no ON to go to
                left, right = (scans(s.left) if s.kind != "LEFT" else left), (scans(s.right) if s.kind != "RIGHT" else right)
            if s.kind in ("LEFT SEMI", "LEFT ANTI", "RIGHT SEMI", "RIGHT ANTI"):
                hidden, a, b = (b, a, []) if s.kind[0] == "L" else (a, [], b)
                if on is None and hidden:
                    left, right = (left, scans(s.right)) if s.kind[0] == "L" else (scans(s.left), right)
                for c in hidden if on is not None else ():
                    on = _and(on, c)
            return replace(s, left=left, right=right, on=on), a + b
        return scans(s), []

    def bare(s: Any) -> list[A.Table]:
        """Tables of a source that its own joins name, without those inside of queries."""
        if isinstance(s, A.Join):
            return bare(s.left) + bare(s.right)
        if isinstance(s, A.LateralView):
            return bare(s.source)
        return [s] if hit(s) else []

    def change(x: Any) -> Any:
        if isinstance(x, A.Select) and x.source is not None and not isinstance(x, RawQuery):
            source, tests = visit(x.source, False)
            where = x.where
            for t in tests:
                where = _and(where, t)
            return replace(x, source=source, where=where)
        if isinstance(x, A.Statement):
            return write(x)
        return x

    def write(x: A.Statement) -> A.Statement:
        if x.kind in ("SHOW", "EXPLAIN", "DESC", "DESCRIBE", "SET", "USE") or x.kind == "DDL" and x.query is not None:
            return x
        if x.kind in ("UPDATE", "DELETE"):
            target = next((t for t in A.walk(x.source) if isinstance(t, A.Table) and t.parts == x.target), None)
            source = scans(x.source, target)
            name = [column] if source is target else [target.alias or target.parts[-1], column]
            return replace(x, source=source, where=_and(x.where, A.Bin("=", A.Name(name), lit)) if asked(x.target[-1]) else x.where)
        if x.kind == "MERGE":
            target = x.source.left
            actions = [owned(a) if a.kind == "NOT MATCHED" and asked(x.target[-1]) else a for a in x.actions]
            return replace(x, source=scans(x.source, target), on=_and(x.on, test(target)) if asked(x.target[-1]) else x.on, actions=actions)
        if x.kind == "INSERT":
            if not asked(x.target[-1]):
                return x
            if not x.columns:
                raise SqlError("a tenant filter needs the columns of an INSERT by name")
            at = next((k for k, c in enumerate(x.columns) if c.lower() == column.lower()), None)
            put = (lambda v: [*v, lit]) if at is None else (lambda v: [*v[:at], lit, *v[at + 1 :]])
            columns = [*x.columns, column] if at is None else x.columns
            return replace(x, columns=columns, rows=[A.Row(put(r.items)) for r in x.rows], query=items(x.query, put) if x.query is not None else None)
        if any(asked(t) for t in [x.target[-1]] if x.target) or not x.target:
            raise SqlError(f"a tenant filter can't be put into {x.verb or x.kind}")
        return x

    def items(q: A.Select, put: Callable[[list[Any]], list[Any]]) -> A.Select:
        if any(isinstance(i, A.Star) for i in q.items) or q.rows is not None:
            raise SqlError("a tenant filter needs the columns of the inserted query by name")
        new = [i if isinstance(i, A.Column) else A.Column(i, column) for i in put(q.items)]
        return replace(q, items=new, sets=[(op, items(arm, put)) for op, arm in q.sets])

    def owned(a: A.Action) -> A.Action:
        if not a.columns:
            raise SqlError("a tenant filter needs the columns of MERGE's INSERT by name")
        at = next((k for k, c in enumerate(a.columns) if c.lower() == column.lower()), None)
        if at is None:
            return replace(a, columns=[*a.columns, column], values=[*a.values, lit])
        return replace(a, values=[*a.values[:at], lit, *a.values[at + 1 :]])

    return A.rewrite(tree, change)


def replace_table(tree: Any, old: str, new: str) -> Any:
    """By the last part of the name, without case; an alias keeps column references valid."""
    def change(x: Any) -> Any:
        if isinstance(x, A.Table) and x.parts[-1].lower() == old.lower():
            return replace(x, parts=new.split("."), alias=x.alias or x.parts[-1])
        return x

    return A.rewrite(tree, change)


def replace_column(tree: Any, old: str, new: str) -> Any:
    return A.rewrite(tree, lambda x: replace(x, parts=[*x.parts[:-1], new]) if isinstance(x, A.Name) and x.parts[-1].lower() == old.lower() else x)


def mask_columns(tree: A.Select, masks: dict[str, str], d: str | Dialect = "mysql") -> A.Select:
    """Select items whose alias or column matches get the mask's expression ({} is the item) and keep their name. In all arms."""
    wanted = {k.lower(): v for k, v in masks.items()}
    em = Emitter(d)

    def arm(q: A.Select) -> A.Select:
        items = []
        for i in q.items:
            name = i.alias or (i.value.parts[-1] if isinstance(i.value, A.Name) else "") if isinstance(i, A.Column) else ""
            own = i.value.parts[-1].lower() if isinstance(i, A.Column) and isinstance(i.value, A.Name) else ""
            mask = wanted.get(name.lower()) or wanted.get(own)
            items.append(A.Column(parse_expr(mask.replace("{}", f"({em.e(i.value)})"), "spark"), name) if mask and name else i)
        return replace(q, items=items, sets=[(op, arm(a)) for op, a in q.sets])

    return arm(tree)


def mask_scans(tree: Any, masks: dict[str, str], columns: Callable[[list[str]], list[str] | None]) -> Any:
    """Masks at the scan: every table that has a masked column is read through a query that masks it, so that stars, expressions, conditions and
    subqueries see only masked values. {} is the column; masks are Spark SQL. Names that no table has are masks of output columns.
    Writes and tables of unknown columns are refused."""
    wanted = {k.lower(): v for k, v in masks.items()}
    ctes = {c.name.lower() for x in A.walk(tree) if isinstance(x, A.Select) for c in x.ctes}
    if isinstance(tree, A.Statement) and tree.kind not in ("INSERT", "INSERT ALL", "SHOW", "EXPLAIN", "DESC", "DESCRIBE") and not (tree.kind == "DDL" and tree.query is not None):
        raise SqlError(f"masks can't be put into {tree.verb or tree.kind}")
    found: set[str] = set()

    def change(x: Any) -> Any:
        if not isinstance(x, A.Table) or x.parts[-1].lower() in ctes | {"dual"}:
            return x
        known = columns(x.parts)
        if known is None:
            raise SqlError(f"masks need the columns of {'.'.join(x.parts)}")
        hit = {c for c in known if c.lower() in wanted}
        if not hit:
            return x
        found.update(c.lower() for c in hit)
        items = [A.Column(wanted[c.lower()].replace("{}", quoted(c)), c) if c in hit else A.Column(A.Name([c])) for c in known]
        return A.Derived(A.Select(items=items, source=replace(x, alias="")), x.alias or x.parts[-1])

    out = A.rewrite(tree, change)
    rest = {k: v for k, v in masks.items() if k.lower() not in found}
    return mask_columns(out, rest, "spark") if rest and isinstance(out, A.Select) else out


def page(tree: A.Select, number: int, size: int) -> A.Select:
    """The rows of a page, both at least 1, over the whole set chain; a limit of its own is kept inside."""
    number, size = max(number, 1), max(size, 1)
    if tree.limit is not None or tree.offset is not None:
        tree = A.Select(items=[A.Star()], source=A.Derived(tree, "page"), order=[])
    return replace(tree, limit=_n(size), offset=_n((number - 1) * size) if number > 1 else None)


def _n(n: int) -> A.Lit:
    return A.Lit("number", str(n))


def add_limit(tree: A.Select, n: int) -> A.Select:
    """A limit where there is none."""
    return tree if get_limit(tree) is not None or tree.limit is not None else replace(tree, limit=_n(n))


def set_limit(tree: A.Select, n: int) -> A.Select:
    """This limit, in place of any other."""
    tree = adapt_pagination(tree)
    return replace(tree, limit=_n(n), percent=False, ties=False)


def set_offset(tree: A.Select, n: int) -> A.Select:
    tree = adapt_pagination(tree)
    return replace(tree, offset=_n(n) if n > 0 else None)


def get_limit(tree: A.Select) -> int | None:
    """The rows that a query is limited to, in any style of paging."""
    tree = adapt_pagination(tree)
    return int(tree.limit.value) if isinstance(tree.limit, A.Lit) else None


def get_offset(tree: A.Select) -> int | None:
    tree = adapt_pagination(tree)
    return int(tree.offset.value) if isinstance(tree.offset, A.Lit) else None


def adapt_pagination(tree: A.Select) -> A.Select:
    """LIMIT and OFFSET for the other styles of paging: ROWNUM tests, nested ROWNUM windows, and row_number() windows over a query in order."""
    if not isinstance(tree, A.Select) or tree.sets or tree.limit is not None or not isinstance(tree.source, A.Derived) and tree.where is None:
        return tree
    most, least, rest = None, 0, []
    inner = tree.source.query if isinstance(tree.source, A.Derived) else None
    numbers = {i.alias.lower(): i.value for i in (inner.items if inner is not None and not inner.sets else []) if isinstance(i, A.Column) and i.alias}

    def kind(x: Any) -> str:
        if isinstance(x, A.Name):
            v = numbers.get(x.parts[-1].lower())
            if x.parts[-1].upper() == "ROWNUM" or isinstance(v, A.Name) and v.parts[-1].upper() == "ROWNUM":
                return "ROWNUM" if x.parts[-1].upper() == "ROWNUM" else "INNER"
            if isinstance(v, A.Call) and v.name.upper() == "ROW_NUMBER" and v.over is not None and not v.over.partition:
                return "WINDOW"
        return ""

    style = ""
    for c in conjuncts(tree.where):
        if isinstance(c, A.Between) and not c.negated and kind(c.value) and isinstance(c.low, A.Lit) and isinstance(c.high, A.Lit):
            style, least, most = kind(c.value), int(c.low.value) - 1, int(c.high.value)
        elif isinstance(c, A.Bin) and kind(c.left) and isinstance(c.right, A.Lit) and c.op in ("<", "<=", ">", ">=", "="):
            style, v = kind(c.left), int(c.right.value)
            if c.op in ("<", "<="):
                most = v - (c.op == "<")
            elif c.op == "=":
                least, most = v - 1, v
            else:
                least = v - (c.op == ">=")
        else:
            rest.append(c)
    if not style or rest:
        return tree
    if style == "ROWNUM":
        if inner is None:
            return replace(tree, where=None, limit=_n(most)) if most is not None and not tree.order else tree
        return replace(inner, limit=_n(most)) if most is not None and _all(tree) else tree
    alias = next(a for a, v in numbers.items() if isinstance(v, A.Name) and v.parts[-1].upper() == "ROWNUM" or isinstance(v, A.Call) and v.name.upper() == "ROW_NUMBER")
    over = numbers[alias]
    base = replace(inner, items=[i for i in inner.items if not (isinstance(i, A.Column) and i.alias.lower() == alias)] or [A.Star()])
    if style == "WINDOW":
        base = replace(base, order=over.over.order)
    else:
        for c in conjuncts(base.where):  # the inner ROWNUM <= m
            if isinstance(c, A.Bin) and isinstance(c.left, A.Name) and c.left.parts[-1].upper() == "ROWNUM" and isinstance(c.right, A.Lit) and c.op in ("<", "<="):
                bound = int(c.right.value) - (c.op == "<")
                most = bound if most is None else min(most, bound)
        base = replace(base, where=_all_and([c for c in conjuncts(base.where) if not any(isinstance(x, A.Name) and x.parts[-1].upper() == "ROWNUM" for x in A.walk(c))]))
        if isinstance(base.source, A.Derived) and _all(base) and base.where is None:
            base = base.source.query
    if most is None:
        return replace(base, offset=_n(least) if least else None)
    return replace(base, limit=_n(most - least), offset=_n(least) if least else None)


def _all(q: A.Select) -> bool:
    return len(q.items) == 1 and isinstance(q.items[0], A.Star) and not q.items[0].excluded


def _all_and(xs: list[Any]) -> Any:
    out = None
    for x in xs:
        out = x if out is None else _and(out, x)
    return out


def add_select_item(tree: A.Select, item: str, alias: str = "", d: str | Dialect = "mysql") -> A.Select:
    """On the first arm."""
    return replace(tree, items=[*tree.items, A.Column(parse_expr(item, d), alias)])


def _named(i: Any) -> str:
    return (i.alias or (i.value.parts[-1] if isinstance(i.value, A.Name) else "")) if isinstance(i, A.Column) else ""


def remove_select_item(tree: A.Select, name: str) -> A.Select:
    """Items of this name or alias, on the first arm; the last item can't go."""
    items = [i for i in tree.items if _named(i).lower() != name.lower()]
    if not items:
        raise ValueError("a query keeps one item at least")
    return replace(tree, items=items)


def replace_select_item(tree: A.Select, name: str, item: str, d: str | Dialect = "mysql") -> A.Select:
    """mask_columns with an expression that doesn't name the item."""
    return mask_columns(tree, {name: item.replace("{", "{{").replace("}", "}}") if "{}" not in item else item}, d)


class Rewrites:
    """An ordered list of changes; each takes a tree and returns one."""

    def __init__(self, *steps: Callable[[Any], Any]):
        self.steps = list(steps)

    def then(self, step: Callable[..., Any], *args: Any, **options: Any) -> Rewrites:
        self.steps.append(lambda tree: step(tree, *args, **options))
        return self

    def __call__(self, tree: Any) -> Any:
        for step in self.steps:
            tree = step(tree)
        return tree


def clone(tree: Any) -> Any:
    return A.rewrite(tree, lambda x: x)


def parameters(sql: str, d: str | Dialect = "mysql") -> list[str]:
    """The parameters of a text, in order."""
    return [t.text for t in Parser(sql, d).toks if t.kind == "param"]


def all_of(*conditions: Any) -> Any:
    return _all_and([c for c in conditions if c is not None])


def any_of(*conditions: Any) -> Any:
    out = None
    for c in conditions:
        if c is not None:
            out = c if out is None else A.Bin("OR", out, c)
    return out


#: Forms of template placeholders, tried in this order: #{x}, ${x}, @x@, <x> and %s in turn.
TEMPLATES = re.compile(r"#\{\s*(\w+)\s*\}|\$\{\s*(\w+)\s*\}|@(\w+)@|<(\w+)>|%s")


def fill_template(text: str, values: dict[str, Any] | list[Any], d: str | Dialect = "mysql") -> str:
    """Placeholders become literals, or identifiers where they stand for a table (behind FROM, JOIN, INTO, UPDATE, TABLE) or are written ${x}.

    Identifiers must look like one; text in quotes is left alone.
    """
    left = list(values) if isinstance(values, list | tuple) else None
    em = Emitter("spark" if str(getattr(d, "name", d)) == "spark" else d)

    def value(key: str) -> Any:
        if left is not None:
            if not left:
                raise SqlError("fewer values than placeholders")
            return left.pop(0)
        if key not in values:
            raise SqlError(f"no value for {key}")
        return values[key]

    def put(m: re.Match, before: str) -> str:
        v = value(next((g for g in m.groups() if g), ""))
        if m[0].startswith("${") or re.search(r"\b(FROM|JOIN|INTO|UPDATE|TABLE)\s*$", before, re.I):
            if not re.fullmatch(r"[A-Za-z_][\w.]*", str(v)):
                raise SqlError(f"{v!r} isn't an identifier")
            return str(v)
        if isinstance(v, list | tuple | set):
            return ", ".join(_sql_literal(em, x) for x in v)
        return _sql_literal(em, v)

    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|" + TEMPLATES.pattern, text):
        out.append(text[at : m.start()])
        out.append(m[0] if m[0][0] == "'" else put(TEMPLATES.fullmatch(m[0]), "".join(out)))
        at = m.end()
    if left:
        raise SqlError(f"{len(left)} values too many")
    return "".join(out) + text[at:]


def _sql_literal(em: Emitter, v: Any) -> str:
    """Quotes are doubled, as every dialect reads them; a backslash is doubled where the dialect escapes with it."""
    x = literal(v)
    if isinstance(x, A.Lit) and x.kind == "string":
        return "'" + (x.value.replace("\\", "\\\\") if em.d.backslash else x.value).replace("'", "''") + "'"
    return em.e(x)


def expand_star(tree: A.Select, columns: Callable[[str], list[str] | None]) -> A.Select:
    """Stars become columns if the columns of all their tables are known."""
    def change(x: Any) -> Any:
        if not isinstance(x, A.Select) or not any(isinstance(i, A.Star) for i in x.items):
            return x
        sources = [t for t in A.walk(x.source) if isinstance(t, A.Table)]
        items: list[Any] = []
        for i in x.items:
            if not isinstance(i, A.Star):
                items.append(i)
                continue
            for t in sources:
                own = t.alias or t.parts[-1]
                if i.table and own.lower() != i.table[-1].lower():
                    continue
                known = columns(t.parts[-1])
                if known is None:
                    return x
                skip = {c.lower() for c in i.excluded}
                items += [A.Column(A.Name([own, c])) for c in known if c.lower() not in skip]
        return replace(x, items=items)

    return A.rewrite(tree, change)


def parameterize(tree: Any) -> tuple[Any, list[Any]]:
    """Literals become ?; their values in order. The text of the tree is then a fingerprint of the query."""
    values: list[Any] = []

    def change(x: Any) -> Any:
        if isinstance(x, A.Lit) and x.kind in ("string", "number"):
            values.append(evaluate(x))
            return A.Param("?")
        return x

    return A.rewrite(tree, change), values


def literal(v: Any) -> Any:
    if v is None:
        return A.Lit("null", "NULL")
    if isinstance(v, bool):
        return A.Lit("bool", str(v).upper())
    if isinstance(v, float) and not math.isfinite(v):
        raise ValueError("NaN and infinity can't be bound")
    if isinstance(v, int | float):
        return A.Un("-", A.Lit("number", repr(abs(v)))) if v < 0 else A.Lit("number", repr(v))
    return A.Lit("string", str(v))


def bind(tree: Any, args: list[Any] | dict[str, Any]) -> Any:
    """Parameters become literals; a list inside IN becomes its items."""
    left = list(args) if isinstance(args, list | tuple) else None

    def value(p: A.Param) -> Any:
        if left is not None:
            if not left:
                raise SqlError("fewer values than parameters")
            return left.pop(0)
        key = p.text.lstrip(":@")
        if key not in args:
            raise SqlError(f"no value for {p.text}")
        return args[key]

    def visit(x: Any) -> Any:  # in text order: a node's fields are in it
        if isinstance(x, A.Param):
            v = value(x)
            return A.Row([literal(i) for i in v]) if isinstance(v, list | tuple | set) else literal(v)
        if isinstance(x, A.In):
            head = visit(x.value)
            if isinstance(x.items, A.Param):
                v = value(x.items)
                return A.In(head, [literal(i) for i in (v if isinstance(v, list | tuple | set) else [v])], x.negated)
            items = visit(x.items)
            if isinstance(items, list):
                items = [i for it in items for i in (it.items if isinstance(it, A.Row) and not isinstance(head, A.Row) else [it])]
            return A.In(head, items, x.negated)
        if isinstance(x, list):
            return [visit(i) for i in x]
        if isinstance(x, tuple):
            return tuple(visit(i) for i in x)
        if isinstance(x, dict):
            return {k: visit(v) for k, v in x.items()}
        if hasattr(x, "__dataclass_fields__"):
            return replace(x, **{k: visit(getattr(x, k)) for k in x.__dataclass_fields__})
        return x

    out = visit(tree)
    if left:
        raise SqlError(f"{len(left)} values too many")
    return out


__all__ = ["Rewrites", "adapt_pagination", "add_select_item", "all_of", "any_of", "clone", "fill_template", "get_limit", "get_offset", "mask_scans", "parameters", "remove_select_item", "replace_select_item", "set_limit", "set_offset", "stat", "tables", "is_read_only", "wall", "WallConfig", "inject", "replace_table", "replace_column", "mask_columns", "page", "add_limit", "expand_star", "parameterize", "bind", "evaluate", "and_where", "conjuncts", "parse"]
