"""Syntax tree of a query. Plain dataclasses; walk() and rewrite() serve every transform."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass
class Lit:
    kind: str  # string, number, null, bool, hex, typed (DATE '…')
    value: str
    type: str = ""


@dataclass
class Name:
    parts: list[str]
    outer: bool = False  # the (+) mark


@dataclass
class Star:
    table: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    replaced: list[tuple[Any, str]] = field(default_factory=list)


@dataclass
class Param:
    text: str  # ?, :name, @name


@dataclass
class Call:
    name: str
    args: list[Any] = field(default_factory=list)
    distinct: bool = False
    order: list[Any] = field(default_factory=list)
    separator: Any = None
    within: list[Any] = field(default_factory=list)
    filter: Any = None
    keep: tuple[str, list[Any]] | None = None
    nulls: str = ""
    over: Any = None
    params: list[Any] | None = None  # quantile(0.9)(x)


@dataclass
class Window:
    base: str = ""
    partition: list[Any] = field(default_factory=list)
    order: list[Any] = field(default_factory=list)
    frame: str = ""


@dataclass
class Bin:
    op: str
    left: Any
    right: Any


@dataclass
class Un:
    op: str
    value: Any


@dataclass
class Is:
    value: Any
    what: str  # NULL, TRUE, FALSE
    negated: bool = False


@dataclass
class Like:
    op: str  # LIKE, ILIKE, RLIKE, SIMILAR
    value: Any
    pattern: Any
    escape: Any = None
    negated: bool = False


@dataclass
class Between:
    value: Any
    low: Any
    high: Any
    negated: bool = False


@dataclass
class In:
    value: Any
    items: Any  # list, Select or Param
    negated: bool = False


@dataclass
class Quantified:
    op: str
    value: Any
    kind: str  # ANY or ALL
    query: Any


@dataclass
class Exists:
    query: Any


@dataclass
class Case:
    operand: Any
    whens: list[tuple[Any, Any]]
    otherwise: Any = None


@dataclass
class Cast:
    value: Any
    type: str
    safe: bool = False


@dataclass
class Interval:
    value: Any
    unit: str


@dataclass
class Extract:
    unit: str
    value: Any


@dataclass
class Row:
    items: list[Any]


@dataclass
class ArrayOf:
    items: list[Any]


@dataclass
class Item:
    """A[i] or A[i:j]."""

    value: Any
    index: Any
    to: Any = None
    ranged: bool = False


@dataclass
class Collate:
    value: Any
    name: str


@dataclass
class AtZone:
    value: Any
    zone: Any


@dataclass
class Column:
    """A select item."""

    value: Any
    alias: str = ""


@dataclass
class Key:
    """An ordering key."""

    value: Any
    desc: bool = False
    nulls: str = ""


@dataclass
class Table:
    parts: list[str]
    alias: str = ""
    sample: tuple[str, str] | None = None  # (percent, seed)
    partition: Any = None  # names of partitions, or (key, value) pairs
    travel: tuple[str, Any] | None = None  # (TIMESTAMP or VERSION, when)


@dataclass
class Derived:
    query: Any
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    lateral: bool = False


@dataclass
class TableCall:
    call: Call
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    ordinality: bool = False
    lateral: bool = False


@dataclass
class Values:
    rows: list[Row]
    alias: str = ""
    columns: list[str] = field(default_factory=list)


@dataclass
class Join:
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS, LEFT SEMI, LEFT ANTI, RIGHT SEMI, RIGHT ANTI, CROSS APPLY, OUTER APPLY
    left: Any
    right: Any
    on: Any = None
    using: list[str] = field(default_factory=list)
    natural: bool = False
    hint: str = ""


@dataclass
class LateralView:
    source: Any
    call: Call
    alias: str
    columns: list[str]
    outer: bool = False


@dataclass
class Pivoted:
    source: Any
    kind: str
    body: str
    alias: str = ""


@dataclass
class JsonRows:
    """JSON_TABLE and OPENJSON: a row for each item at a path; columns: (name, type or ORDINALITY, path)."""

    value: Any
    path: str
    fields: list[tuple[str, str, str]]
    alias: str = ""


@dataclass
class Matched:
    """MATCH_RECOGNIZE."""

    source: Any
    partition: list[Any]
    order: list[Any]
    measures: list[tuple[Any, str]]
    all_rows: bool
    skip: str
    pattern: str
    define: list[tuple[str, Any]]
    alias: str = ""
    within: Any = None


@dataclass
class Cte:
    name: str
    columns: list[str]
    query: Any
    search: tuple[str, list[str], str] | None = None  # (DEPTH or BREADTH, keys, column)
    cycle: tuple[list[str], str, str] | None = None  # (columns, flag, path)


@dataclass
class Select:
    ctes: list[Cte] = field(default_factory=list)
    recursive: bool = False
    distinct: bool = False
    distinct_on: list[Any] = field(default_factory=list)
    items: list[Any] = field(default_factory=list)
    source: Any = None
    where: Any = None
    start: Any = None
    connect: Any = None
    nocycle: bool = False
    group: list[Any] = field(default_factory=list)
    grouping: str = ""  # ROLLUP, CUBE, ALL (GROUP BY ()), or empty
    having: Any = None
    qualify: Any = None
    windows: dict[str, Window] = field(default_factory=dict)
    sets: list[tuple[str, Any]] = field(default_factory=list)
    order: list[Any] = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    ties: bool = False
    percent: bool = False
    limit_by: tuple[Any, list[Any]] | None = None
    locked: bool = False
    into: str = ""
    rows: list[Row] | None = None  # VALUES
    nested: bool = False  # was in parentheses
    hints: str = ""
    siblings: bool = False  # ORDER SIBLINGS BY
    distinct_sets: bool = False  # GROUP BY DISTINCT
    preferring: list[tuple[str, Any]] = field(default_factory=list)  # (HIGH or LOW, value)
    shape: str = ""  # FOR JSON


@dataclass
class Statement:
    """Any statement that isn't a query: the parts that governance needs."""

    kind: str  # INSERT, UPDATE, DELETE, MERGE, INSERT ALL, LOAD, COPY, DDL, SET, OTHER
    text: str
    target: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    source: Any = None
    assignments: list[tuple[Any, Any]] = field(default_factory=list)
    where: Any = None
    query: Any = None
    rows: list[Row] = field(default_factory=list)
    on: Any = None
    verb: str = ""
    overwrite: bool = False
    conflict: Any = None  # Conflict
    actions: list[Any] = field(default_factory=list)  # of MERGE and INSERT ALL
    order: list[Any] = field(default_factory=list)
    limit: Any = None
    returning: list[Any] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Conflict:
    """What an insert does with keys that are there. keys: empty if the table's own; assignments: none to keep the row there."""

    keys: list[str] = field(default_factory=list)
    assignments: list[tuple[Any, Any]] = field(default_factory=list)
    replace: bool = False
    where: Any = None


@dataclass
class Action:
    """A WHEN branch of MERGE (kind: MATCHED, NOT MATCHED, BY SOURCE) or of INSERT ALL and FIRST (kind: INTO)."""

    kind: str
    when: Any = None
    delete: bool = False
    assignments: list[tuple[Any, Any]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)
    target: list[str] = field(default_factory=list)


def children(node: Any) -> Iterator[Any]:
    if is_dataclass(node):
        for f in fields(node):
            yield from _flat(getattr(node, f.name))


def _flat(value: Any) -> Iterator[Any]:
    if is_dataclass(value):
        yield value
    elif isinstance(value, list | tuple):
        for x in value:
            yield from _flat(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from _flat(x)


def walk(node: Any) -> Iterator[Any]:
    """The node and all below it, parents first."""
    yield node
    for c in children(node):
        yield from walk(c)


def rewrite(node: Any, change: Callable[[Any], Any]) -> Any:
    """A changed copy, children first."""
    if isinstance(node, list):
        return [rewrite(x, change) for x in node]
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if isinstance(node, dict):
        return {k: rewrite(v, change) for k, v in node.items()}
    if not is_dataclass(node):
        return node
    return change(replace(node, **{f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}))
