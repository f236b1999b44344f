"""Writes as table states: the rows that a table has after a statement, as one query.

Files of Parquet take no row changes, so INSERT, upserts, UPDATE, DELETE and MERGE are queries over the table and what they read; the
engine makes the result the table's new rows. Nothing is collected, and each row is looked at in one join at most.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from . import ast as A
from .emit import Emitter, quoted
from .lexer import SqlError

Schema = list[tuple[str, str]]  # columns and their types


def _column(schema: Schema, name: str) -> str:
    found = next((c for c, _ in schema if c.lower() == name.lower()), None)
    if found is None:
        raise SqlError(f"no column {name}")
    return found


def _own(x: Any, alias: str, others: tuple[str, ...] = ()) -> Any:
    """Bare names belong to `alias`; EXCLUDED.c and VALUES(c) are columns of the new row."""
    def change(n: Any) -> Any:
        if isinstance(n, A.Call) and n.name.upper() == "VALUES" and others:
            return A.Name([others[0], n.args[0].parts[-1]])
        if isinstance(n, A.Name) and len(n.parts) > 1 and others and n.parts[-2].lower() in ("excluded", "new"):
            return A.Name([others[0], n.parts[-1]])
        return A.Name([alias, n.parts[0]]) if isinstance(n, A.Name) and len(n.parts) == 1 else n

    if isinstance(x, A.Call) and x.name.upper() == "VALUES" and others:
        return A.Name([others[0], x.args[0].parts[-1]])
    return A.rewrite(x, change)


def new_rows(em: Emitter, s: A.Statement, schema: Schema) -> str:
    """What an INSERT adds, with the table's columns and types; columns that it leaves out are null."""
    given = [_column(schema, c) for c in s.columns] or [c for c, _ in schema]
    if s.query is None:
        width = {len(r.items) for r in s.rows}
        if width == {0}:
            rows, given = "(SELECT 1)", []
        elif width != {len(given)}:
            raise SqlError(f"{len(given)} columns, but rows of {sorted(width)} values")
        else:
            rows = f"(VALUES {', '.join(em.e(r) for r in s.rows)})"
    else:
        rows = f"({em.query(s.query)})"
    place = {c: f"__c{k}" for k, c in enumerate(given)}
    cols = ", ".join(f"CAST({place[c] if c in place else 'NULL'} AS {t}) AS {quoted(c)}" for c, t in schema)
    return f"SELECT {cols} FROM {rows} AS __n{'(' + ', '.join(place.values()) + ')' if place else ''}"


def insert(em: Emitter, s: A.Statement, schema: Schema, keys: list[str]) -> str:
    name, rows = ".".join(map(quoted, s.target)), new_rows(em, s, schema)
    cols = ", ".join(quoted(c) for c, _ in schema)
    if s.overwrite:
        return rows
    if s.conflict is None:
        return f"SELECT {cols} FROM {name} UNION ALL {rows}"
    keys = [_column(schema, k) for k in (s.conflict.keys or keys)]
    if not keys:
        raise SqlError(f"an upsert needs the keys of {s.target[-1]}")
    c, by = s.conflict, ", ".join(map(quoted, keys))
    # Of new rows with one key the first counts, or the last if rows replace each other.
    numbered = f"SELECT *, monotonically_increasing_id() AS __k FROM ({rows})"
    rows = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY __k{' DESC' if c.replace or c.assignments else ''}) AS __turn FROM ({numbered})"
    rows = f"SELECT {cols}, TRUE AS __hit FROM ({rows}) WHERE __turn = 1"
    changes = {_column(schema, a.parts[-1]): _own(b, "__t", ("__n", s.options.get("alias", "excluded"))) for a, b in c.assignments}
    if alias := s.options.get("alias"):
        changes = {k: A.rewrite(v, lambda n: A.Name(["__n", n.parts[-1]]) if isinstance(n, A.Name) and len(n.parts) > 1 and n.parts[-2].lower() == alias.lower() else n) for k, v in changes.items()}
    changes = {k: A.rewrite(v, lambda n: A.Name(["__t", n.parts[-1]]) if isinstance(n, A.Name) and len(n.parts) > 1 and n.parts[-2].lower() == s.target[-1].lower() else n) for k, v in changes.items()}
    guard = f" AND {em.e(_own(c.where, '__t', ('__n',)), 3)}" if c.where is not None else ""
    out = []
    for col, kind in schema:
        q = quoted(col)
        both = f"__n.{q}" if c.replace else f"CAST({em.e(changes[col])} AS {kind})" if col in changes else f"__t.{q}"
        out.append(f"CASE WHEN __t.__own IS NULL THEN __n.{q} WHEN __n.__hit{guard} THEN {both} ELSE __t.{q} END AS {q}")
    on = " AND ".join(f"__t.{quoted(k)} = __n.{quoted(k)}" for k in keys)
    return f"SELECT {', '.join(out)} FROM (SELECT *, TRUE AS __own FROM {name}) AS __t FULL OUTER JOIN ({rows}) AS __n ON {on}"


def _split(source: Any, of: str) -> tuple[A.Table, Any, list[Any]]:
    """(target, the other sources, join conditions) of the sources of an UPDATE or DELETE."""
    if isinstance(source, A.Table):
        return source, None, []
    parts: list[Any] = []
    conds: list[Any] = []

    def flat(s: Any) -> None:
        if isinstance(s, A.Join) and s.kind in ("INNER", "CROSS") and not s.using and not s.natural:
            flat(s.left)
            flat(s.right)
            if s.on is not None:
                conds.append(s.on)
        else:
            parts.append(s)

    flat(source)
    target = next((p for p in parts if isinstance(p, A.Table) and (p.alias or p.parts[-1]).lower() == of.lower()), None)
    if target is None:
        raise SqlError("a write over an outer join isn't supported")
    rest = [p for p in parts if p is not target]
    other = rest[0]
    for p in rest[1:]:
        other = A.Join("CROSS", other, p)
    return target, other, conds


def _conj(xs: list[Any]) -> Any:
    out = None
    for x in xs:
        if x is not None:
            out = x if out is None else A.Bin("AND", out, x)
    return out


def update(em: Emitter, s: A.Statement, schema: Schema) -> str:
    of = next((x.alias or x.parts[-1] for x in A.walk(s.source) if isinstance(x, A.Table) and x.parts == s.target), s.target[-1])
    target, other, conds = _split(s.source, of)
    alias, name = target.alias or target.parts[-1], ".".join(map(quoted, target.parts))
    changes = {_column(schema, a.parts[-1]): b for a, b in s.assignments}
    if other is None:
        hit = f"coalesce({em.e(s.where)}, FALSE)" if s.where is not None else "TRUE"
        rows = f"{name} AS {quoted(alias)}"
        if s.limit is not None:
            order = ", ".join(em.key(k) for k in s.order) or "1"
            rows = f"(SELECT *, row_number() OVER (PARTITION BY {hit} ORDER BY {order}) AS __turn FROM {rows}) AS {quoted(alias)}"
            hit = f"{hit} AND __turn <= {em.e(s.limit)}"
        cols = [f"CASE WHEN {hit} THEN CAST({em.e(changes[c])} AS {t}) ELSE {quoted(alias)}.{quoted(c)} END AS {quoted(c)}" if c in changes else f"{quoted(alias)}.{quoted(c)}" for c, t in schema]
        return f"SELECT {', '.join(cols)} FROM {rows}"
    if s.limit is not None:
        raise SqlError("LIMIT in an UPDATE over a join")
    on = _conj([*conds, s.where]) or A.Lit("bool", "TRUE")
    rows = f"(SELECT *, monotonically_increasing_id() AS __r FROM {name}) AS {quoted(alias)} LEFT JOIN (SELECT *, TRUE AS __hit FROM {em.source(other)}) AS {quoted(getattr(other, 'alias', '') or other.parts[-1])} ON {em.e(on)}" if isinstance(other, A.Table | A.Derived) else ""
    if not rows:
        raise SqlError("an UPDATE over more than one other table: put them into a query")
    cols = [f"CASE WHEN __hit THEN CAST({em.e(changes[c])} AS {t}) ELSE {quoted(alias)}.{quoted(c)} END AS {quoted(c)}" if c in changes else f"{quoted(alias)}.{quoted(c)} AS {quoted(c)}" for c, t in schema]
    # A row that meets several others is changed by one of them.
    inner = f"SELECT {', '.join(cols)}, row_number() OVER (PARTITION BY __r ORDER BY __r) AS __turn FROM {rows}"
    return f"SELECT {', '.join(quoted(c) for c, _ in schema)} FROM ({inner}) WHERE __turn = 1"


def delete(em: Emitter, s: A.Statement, schema: Schema) -> str:
    target, other, conds = _split(s.source, s.options.get("of", s.target[-1]))
    alias, name = target.alias or target.parts[-1], ".".join(map(quoted, target.parts))
    cols = ", ".join(quoted(c) for c, _ in schema)
    if other is None:
        if s.where is None and s.limit is None:
            return f"SELECT {cols} FROM {name} WHERE FALSE"
        hit = f"coalesce({em.e(s.where)}, FALSE)" if s.where is not None else "TRUE"
        if s.limit is None:
            return f"SELECT {cols} FROM {name} AS {quoted(alias)} WHERE NOT {hit}"
        order = ", ".join(em.key(k) for k in s.order) or "1"
        rows = f"SELECT *, {hit} AS __hit, row_number() OVER (PARTITION BY {hit} ORDER BY {order}) AS __turn FROM {name} AS {quoted(alias)}"
        return f"SELECT {cols} FROM ({rows}) WHERE NOT __hit OR __turn > {em.e(s.limit)}"
    on = _conj([*conds, s.where]) or A.Lit("bool", "TRUE")
    return f"SELECT {', '.join(f'{quoted(alias)}.{quoted(c)}' for c, _ in schema)} FROM {name} AS {quoted(alias)} LEFT ANTI JOIN {em.source(other)} ON {em.e(on)}"


def merge(em: Emitter, s: A.Statement, schema: Schema) -> str:
    """Branches are tried in order, the first that holds acts. A row that two source rows would change is an error, as the clause demands."""
    target, source = s.source.left, s.source.right
    t, name = target.alias or target.parts[-1], ".".join(map(quoted, target.parts))
    n = getattr(source, "alias", "") or source.parts[-1]
    kinds = {"MATCHED": "__own AND __hit", "NOT MATCHED": "__own IS NULL", "BY SOURCE": "__hit IS NULL"}
    tests = [f"WHEN {kinds[a.kind]}" + (f" AND {em.e(a.when, 3)}" if a.when is not None else "") + f" THEN {k}" for k, a in enumerate(s.actions)]
    act = f"CASE {' '.join(tests)} ELSE -1 END"
    out = []
    for c, kind in schema:
        cases = []
        for k, a in enumerate(s.actions):
            if a.delete:
                continue
            if a.assignments and isinstance(a.assignments[0][0], A.Star) or a.values and isinstance(a.values[0], A.Star):
                new = f"{quoted(n)}.{quoted(c)}"
            elif a.assignments:
                changes = {_column(schema, x.parts[-1]): v for x, v in a.assignments}
                if c not in changes:
                    continue
                new = em.e(changes[c])
            elif a.values:
                given = [_column(schema, x) for x in a.columns] or [x for x, _ in schema]
                new = em.e(a.values[given.index(c)]) if c in given else "NULL"
            else:
                continue
            cases.append(f"WHEN {k} THEN CAST({new} AS {kind})")
        old = f"{quoted(t)}.{quoted(c)}"
        out.append(f"CASE __act {' '.join(cases)} ELSE {old} END AS {quoted('__new_' + c)}" if cases else f"{old} AS {quoted('__new_' + c)}")
    rows = em.source(replace(source, alias="") if isinstance(source, A.Table) else source)
    joined = f"(SELECT *, monotonically_increasing_id() AS __r, TRUE AS __own FROM {name}) AS {quoted(t)} FULL OUTER JOIN (SELECT *, monotonically_increasing_id() AS __s, TRUE AS __hit FROM {rows}) AS {quoted(n)} ON {em.e(s.on)}"
    inner = f"SELECT {act} AS __act, __own, __hit, coalesce(__r, -1 - __s) AS __row, {', '.join(out)} FROM {joined}"
    counted = f"SELECT *, count_if(__act >= 0 AND __own AND __hit) OVER (PARTITION BY __row) AS __times, row_number() OVER (PARTITION BY __row ORDER BY __act DESC) AS __turn FROM ({inner})"
    deleted = [k for k, a in enumerate(s.actions) if a.delete]
    keep = "(__own OR __act >= 0) AND __turn = 1" + (f" AND __act NOT IN ({', '.join(map(str, deleted))})" if deleted else "")
    guard = "CASE WHEN __times > 1 THEN raise_error('MERGE: several source rows change one row') IS NULL ELSE TRUE END"
    cols = ", ".join(f"{quoted('__new_' + c)} AS {quoted(c)}" for c, _ in schema)
    return f"SELECT {cols} FROM ({counted}) WHERE {keep} AND {guard}"


def state(em: Emitter, s: A.Statement, schema: Schema, keys: list[str]) -> str:
    """The query for the rows that the target has after the statement."""
    if s.kind == "INSERT":
        return insert(em, s, schema, keys)
    if s.kind == "UPDATE":
        return update(em, s, schema)
    if s.kind == "DELETE":
        return delete(em, s, schema)
    return merge(em, s, schema)


def changed(em: Emitter, s: A.Statement, schema: Schema) -> str | None:
    """The rows that RETURNING and OUTPUT speak of: new rows of an insert, changed ones of an update, old ones of a delete."""
    if not s.returning:
        return None
    items = [replace(i, value=A.rewrite(i.value, lambda n: A.Name(n.parts[-1:]) if isinstance(n, A.Name) else n)) if isinstance(i, A.Column) else A.Star() for i in s.returning]
    head = ", ".join(em.e(i.value) + (f" AS {quoted(i.alias)}" if i.alias else "") if isinstance(i, A.Column) else "*" for i in items)
    if s.kind == "INSERT":
        return f"SELECT {head} FROM ({new_rows(em, s, schema)})"
    if not isinstance(s.source, A.Table) or s.limit is not None:
        raise SqlError("RETURNING of a write over a join or with a limit")
    tail = f" WHERE {em.e(s.where)}" if s.where is not None else ""
    rows = f"SELECT * FROM {em.source(s.source)}{tail}"
    if s.kind == "UPDATE":
        rows = _updated(em, s, schema, rows)
    return f"SELECT {head} FROM ({rows})"


def _updated(em: Emitter, s: A.Statement, schema: Schema, rows: str) -> str:
    changes = {_column(schema, a.parts[-1]): b for a, b in s.assignments}
    alias = s.source.alias or s.source.parts[-1]
    cols = ", ".join(f"CAST({em.e(changes[c])} AS {t}) AS {quoted(c)}" if c in changes else quoted(c) for c, t in schema)
    return f"SELECT {cols} FROM ({rows}) AS {quoted(alias)}"


def branches(em: Emitter, s: A.Statement, schemas: dict[str, Schema]) -> list[tuple[list[str], str]]:
    """INSERT ALL and FIRST: for each branch its target and the rows that it adds."""
    out, before = [], []
    source = em.query(s.query)
    hits = [em.e(a.when, 3) for a in s.actions if a.when is not None and not (isinstance(a.when, A.Lit) and a.when.value == "ELSE")]
    for a in s.actions:
        if a.when is None:
            test = "TRUE"
        elif isinstance(a.when, A.Lit) and a.when.value == "ELSE":
            test = " AND ".join(f"NOT coalesce({h}, FALSE)" for h in dict.fromkeys(hits)) or "TRUE"
        else:
            own = em.e(a.when, 3)
            test = " AND ".join([f"coalesce({own}, FALSE)", *(f"NOT coalesce({b}, FALSE)" for b in dict.fromkeys(before) if b != own)]) if s.verb == "FIRST" else own
            before.append(own)
        schema = schemas[a.target[-1].lower()]
        given = [_column(schema, c) for c in a.columns] or [c for c, _ in schema]
        values = [em.e(v) for v in a.values] or [quoted(c) for c in given]
        if len(values) != len(given):
            raise SqlError(f"{len(given)} columns, but {len(values)} values")
        place = dict(zip(given, values, strict=True))
        cols = ", ".join(f"CAST({place.get(c, 'NULL')} AS {t}) AS {quoted(c)}" for c, t in schema)
        out.append((a.target, f"SELECT {cols} FROM ({source}) WHERE {test}"))
    return out
