"""Entities: a described table, its DDL, and its statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import types as T

from ..plans.emit import Emitter, quoted
from ..plans.govern import literal


@dataclass
class Field:
    name: str
    type: str  # a Spark type, as in DDL
    key: bool = False
    required: bool = False
    comment: str = ""
    references: str = ""  # table


@dataclass
class Entity:
    table: str
    fields: list[Field]
    comment: str = ""
    partition_by: list[str] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.key]

    def schema(self) -> T.StructType:
        ddl = ", ".join(f"{quoted(f.name)} {f.type}" for f in self.fields)
        parsed = T.StructType.fromDDL(ddl)
        return T.StructType([T.StructField(p.name, p.dataType, not (f.required or f.key), {"comment": f.comment} if f.comment else {}) for p, f in zip(parsed, self.fields, strict=True)])

    def create_table(self, source: str = "parquet", if_not_exists: bool = True) -> str:
        def column(f: Field) -> str:
            return f"{quoted(f.name)} {f.type.upper()}{' NOT NULL' * (f.required or f.key)}" + (f" COMMENT {text(f.comment)}" if f.comment else "")

        out = f"CREATE TABLE {'IF NOT EXISTS ' * if_not_exists}{self.table} ({', '.join(map(column, self.fields))}) USING {source}"
        out += f" PARTITIONED BY ({', '.join(map(quoted, self.partition_by))})" if self.partition_by else ""
        return out + (f" COMMENT {text(self.comment)}" if self.comment else "")

    def insert(self, rows: list[dict[str, Any]]) -> str:
        cols = [f.name for f in self.fields if any(f.name in r for r in rows)]
        values = ", ".join(f"({', '.join(value(r.get(c)) for c in cols)})" for r in rows)
        return f"INSERT INTO {self.table} ({', '.join(map(quoted, cols))}) VALUES {values}"

    def select_by_key(self, *key: Any) -> str:
        test = " AND ".join(f"{quoted(k)} = {value(v)}" for k, v in zip(self.keys, key, strict=True))
        return f"SELECT {', '.join(quoted(f.name) for f in self.fields)} FROM {self.table} WHERE {test}"

    def delete_by_key(self, *key: Any) -> str:
        return f"DELETE FROM {self.table} WHERE " + " AND ".join(f"{quoted(k)} = {value(v)}" for k, v in zip(self.keys, key, strict=True))

    def update_by_key(self, row: dict[str, Any]) -> str:
        sets = ", ".join(f"{quoted(f.name)} = {value(row[f.name])}" for f in self.fields if f.name in row and not f.key)
        return f"UPDATE {self.table} SET {sets} WHERE " + " AND ".join(f"{quoted(k)} = {value(row[k])}" for k in self.keys)


def text(s: str) -> str:
    return Emitter("spark").e(literal(s))


def value(v: Any) -> str:
    return Emitter("spark").e(literal(v))


def creation_order(entities: list[Entity]) -> list[Entity]:
    """Referenced tables before those that refer to them; a table may refer to itself."""
    known = {e.table: e for e in entities}
    order = TopologicalSorter({e.table: {f.references for f in e.fields if f.references in known and f.references != e.table} for e in entities})
    return [known[t] for t in order.static_order()]
