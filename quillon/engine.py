"""The entry point: a query or a write in any dialect, under governance, as a Spark DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.matching import match_rows, tests_of
from .plans import ast as A
from .plans import dml
from .plans import govern as G
from .plans import targets
from .plans.emit import Emitter, quoted, to_spark
from .plans.lexer import SqlError
from .plans.parser import parse

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class PolicyError(ValueError):
    """The wall forbids a statement."""


class Engine:
    """Tables of a folder and views by name. A write gives its table new rows under the same name: files are never changed.

    keys: the key columns of tables, for upserts without ON CONFLICT. partitions: (table, partition) -> condition.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, keys: dict[str, list[str]] | None = None, partitions: dict[tuple[str, str], str] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.keys = {k.lower(): v for k, v in (keys or {}).items()}
        self.partitions = {(t.lower(), p.lower()): v for (t, p), v in (partitions or {}).items()}
        self.last_sql = ""
        self.warnings: list[str] = []
        self.known: set[str] = set()

    def add(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self.known.add(name.lower())

    def settle(self, name: str) -> None:
        """Cut the lineage of a table that many writes have changed: its rows are written to spark.checkpoint.dir."""
        self.add(name, self.spark.table(name).checkpoint())

    def _open(self, tree: Any) -> None:
        """Views of the folder's tables that a statement names; files of others aren't touched."""
        names = [x.parts[-1] for x in A.walk(tree) if isinstance(x, A.Table)]
        names += [t[-1] for x in A.walk(tree) if isinstance(x, A.Statement | A.Action) and (t := x.target)]
        for name in map(str.lower, names if self.sf_dir else ()):
            if name in TABLES and name not in self.known:
                self.add(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def _columns(self, parts: list[str]) -> list[str] | None:
        name = ".".join(map(quoted, parts))
        return self.spark.table(name).columns if self.spark.catalog.tableExists(name) else None

    def prepare(self, text: str, dialect: str = "mysql", *, args: list[Any] | dict[str, Any] | None = None, tenant: tuple[str, Any] | None = None, tenant_tables: list[str] | None = None, masks: dict[str, str] | None = None, page: tuple[int, int] | None = None, wall: G.WallConfig | None = None, tables: dict[str, str] | None = None, rewrites: Callable[[Any], Any] | None = None) -> Any:
        """The governed tree. The tenant filter is put in before the masks, so that it tests the real values."""
        if wall is not None and (broken := G.wall(text, dialect, wall)):
            raise PolicyError(", ".join(broken))
        tree = parse(text, dialect)
        if args is not None:
            tree = G.bind(tree, args)
        for old, new in (tables or {}).items():
            tree = G.replace_table(tree, old, new)
        if rewrites is not None:
            tree = rewrites(tree)
        self._open(tree)
        if tenant:
            tree = G.inject(tree, *tenant, only=tenant_tables)
        if masks:
            tree = G.mask_scans(self._unmask_tenant(tree, tenant, masks), masks, self._columns)
        if page:
            if not isinstance(tree, A.Select):
                raise SqlError("only queries have pages")
            tree = G.page(tree, *page)
        return A.rewrite(tree, lambda x: self._match(x, dialect) if isinstance(x, A.Matched) else x)

    @staticmethod
    def _unmask_tenant(tree: Any, tenant: tuple[str, Any] | None, masks: dict[str, str]) -> Any:
        if tenant and tenant[0].lower() in {k.lower() for k in masks}:
            raise PolicyError(f"{tenant[0]} can't be both the tenant column and masked")
        return tree

    def plan(self, text: str, dialect: str = "mysql", **options: Any) -> str:
        """The Spark SQL that would run: of a write, the query for its table's new rows."""
        tree = self.prepare(text, dialect, **options)
        if isinstance(tree, A.Statement) and tree.kind in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            self.last_sql = dml.state(self._emitter(dialect), tree, self._schema(tree.target), self.keys.get(tree.target[-1].lower(), []))
        else:
            self.last_sql, self.warnings = to_spark(tree, dialect, self.partitions)
        return self.last_sql

    def sql(self, text: str, dialect: str = "mysql", **options: Any) -> DataFrame:
        """Catalyst gets one declarative plan; nothing is executed here. A write returns its table's new rows, or what RETURNING asks for."""
        tree = self.prepare(text, dialect, **options)
        if isinstance(tree, A.Statement) and tree.kind in ("INSERT", "UPDATE", "DELETE", "MERGE", "INSERT ALL", "LOAD", "COPY"):
            return self._write(tree, dialect)
        if isinstance(tree, A.Statement) and tree.kind == "DDL" and tree.query is not None and tree.target and "VIEW" in tree.options["head"].upper().split():
            self.add(tree.target[-1], self.spark.sql(self._emitter(dialect).query(tree.query)))
            return self.spark.table(quoted(tree.target[-1]))
        self.last_sql, self.warnings = to_spark(tree, dialect, self.partitions)
        return self.spark.sql(self.last_sql)

    def write(self, builder: Any) -> DataFrame:
        """A write (or query) of the builders, or a tree."""
        tree = getattr(builder, "tree", builder)
        self._open(tree)
        return self._write(tree, "spark") if isinstance(tree, A.Statement) else self.spark.sql(to_spark(tree, "spark", self.partitions)[0])

    def _emitter(self, dialect: str) -> Emitter:
        em = Emitter(dialect)
        em.partitions = self.partitions
        return em

    def _schema(self, target: list[str]) -> dml.Schema:
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(".".join(map(quoted, target))).schema]

    def _write(self, s: A.Statement, dialect: str) -> DataFrame:
        em = self._emitter(dialect)
        if s.kind == "INSERT ALL":
            schemas = {a.target[-1].lower(): self._schema(a.target) for a in s.actions}
            found = [(t, self.spark.sql(q)) for t, q in dml.branches(em, s, schemas)]
            for target, rows in found:
                self.add(target[-1], self.spark.table(".".join(map(quoted, target))).unionByName(rows))
            counts = [rows.groupBy().agg(F.count("*").alias("n")).select(F.lit(".".join(t)).alias("target"), "n") for t, rows in found]
            out = counts[0]
            for c in counts[1:]:
                out = out.unionByName(c)
            return out.groupBy("target").agg(F.sum("n").alias("n"))
        if s.kind in ("LOAD", "COPY"):
            return self._file(s, em)
        schema, name = self._schema(s.target), s.target[-1]
        back = dml.changed(em, s, schema)
        returned = self.spark.sql(back) if back else None
        self.last_sql = dml.state(em, s, schema, self.keys.get(name.lower(), []))
        new = self.spark.sql(self.last_sql)
        self.add(name, new)
        return new if returned is None else returned

    def _file(self, s: A.Statement, em: Emitter) -> DataFrame:
        o = s.options
        csv = {"sep": o["sep"], "quote": o["quote"] or "\0", "header": o.get("header", "false"), "escape": o.get("escape", o["quote"] or "\0"), "nullValue": o.get("null", "")} | ({"encoding": o["encoding"]} if "encoding" in o else {}) | ({"lineSep": o["line"]} if "line" in o else {})
        if o.get("way") == "TO":
            rows = self.spark.sql(em.query(s.query)) if s.query is not None else self.spark.table(".".join(map(quoted, s.target)))
            rows = rows.select(*s.columns) if s.columns else rows
            rows.write.mode("overwrite").options(**csv).csv(o["path"])
            return rows
        table = self.spark.table(".".join(map(quoted, s.target)))
        given = s.columns or table.columns
        kinds = dict(table.dtypes)
        rows = self.spark.read.options(**csv).csv(o["path"], schema=", ".join(f"{quoted(c)} {kinds[next(k for k in kinds if k.lower() == c.lower())]}" for c in given))
        if int(o.get("skip", 0)):  # the first lines of each file
            n = int(o["skip"])
            if n > 1:
                raise SqlError("more than one line to skip")
            rows = self.spark.read.options(**csv | {"header": "true", "enforceSchema": "true"}).csv(o["path"], schema=rows.schema)
        added = rows.select(*(F.col(quoted(c)).cast(kinds[c]).alias(c) if c.lower() in {g.lower() for g in given} else F.lit(None).cast(kinds[c]).alias(c) for c in table.columns))
        new = table.unionByName(added)
        self.add(s.target[-1], new)
        return new

    def _match(self, m: A.Matched, dialect: str) -> A.Table:
        """MATCH_RECOGNIZE: its rows become a view."""
        em = self._emitter(dialect)
        source = self.spark.sql(em.query(A.Select(items=[A.Star()], source=m.source)))
        rows = match_rows(source, [em.e(x) for x in m.partition], [em.key(k) for k in m.order], tests_of(em, m), m.pattern, [(name, x) for x, name in m.measures], m.all_rows, m.skip, em, m.within)
        view = f"match_{uuid.uuid4().hex[:10]}"
        self.add(view, rows)
        return A.Table([view], m.alias)

    def expand_star(self, tree: A.Select) -> A.Select:
        return G.expand_star(tree, lambda table: self._columns([table]))


def convert(text: str, source: str, target: str = "spark") -> dict[str, Any]:
    """{sql, warnings, error}: one statement in another dialect. An error is never hidden."""
    if target != "spark":
        return targets.convert(text, source, target)
    try:
        sql, warnings = to_spark(parse(text, source), source)
        return {"sql": sql, "warnings": warnings, "error": None}
    except ValueError as e:
        return {"sql": None, "warnings": [], "error": str(e)}


def convert_all(statements: DataFrame, sql_col: str = "sql", dialect_col: str = "dialect", target: str = "spark") -> DataFrame:
    """A table of statements, converted on the executors."""

    @F.pandas_udf("struct<sql:string,warnings:array<string>,error:string>")
    def run(sql: pd.Series, dialect: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert(a, b, target) for a, b in zip(sql, dialect, strict=True)], columns=["sql", "warnings", "error"])

    return statements.withColumn("converted", run(sql_col, dialect_col))


def inspect_all(statements: DataFrame, sql_col: str = "sql", dialect_col: str = "dialect", config: G.WallConfig | None = None) -> DataFrame:
    """A table of statements with what each touches: tables as name:access, columns, functions, whether it only reads, and the wall's codes."""

    def look(text: str, dialect: str) -> dict[str, Any]:
        codes = G.wall(text, dialect, config)
        try:
            s = G.stat(text, dialect)
        except ValueError:
            return {"tables": [], "columns": [], "functions": [], "read_only": None, "codes": codes}
        return {"tables": sorted(f"{t}:{k}" for t, kinds in s.tables.items() for k in kinds), "columns": sorted(s.columns), "functions": sorted(s.functions), "read_only": s.read_only, "codes": codes}

    @F.pandas_udf("struct<tables:array<string>,columns:array<string>,functions:array<string>,read_only:boolean,codes:array<string>>")
    def run(sql: pd.Series, dialect: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([look(a, b) for a, b in zip(sql, dialect, strict=True)], columns=["tables", "columns", "functions", "read_only", "codes"])

    return statements.withColumn("seen", run(sql_col, dialect_col))
