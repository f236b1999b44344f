"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8", multi_line: bool = False, strict: bool = True, columns: list[str] | None = None) -> DataFrame:
    """All columns are text. strict: a malformed row is an error; else it is kept in _corrupt. Doubled quotes escape; blank lines are skipped.
    Without multi_line a file is split among tasks."""
    reader = spark.read.option("header", columns is None).option("sep", separator).option("quote", '"').option("escape", '"').option("encoding", encoding).option("multiLine", multi_line)
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("ignoreLeadingWhiteSpace", strict).option("ignoreTrailingWhiteSpace", strict)
    if columns:
        fields = [T.StructField(c, T.StringType()) for c in columns] + ([] if strict else [T.StructField("_corrupt", T.StringType())])
        reader = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.csv(path)


def typed(df: DataFrame, types: dict[str, str], required: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """Text columns as types; a required column that is null or empty is an error."""
    out = []
    for c in df.columns:
        x = F.col(c)
        if c in (required or []):
            x = F.when(F.coalesce(x, F.lit("")) == "", F.raise_error(F.lit(f"{c} is required"))).otherwise(x)
        kind = types.get(c)
        if kind in ("date", "timestamp") and c in (patterns or {}):
            x = (F.to_date if kind == "date" else F.to_timestamp)(x, patterns[c])
        elif kind:
            x = x.cast(kind)
        out.append(x.alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def read_ndjson(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT text a row."""
    def value(f: T.StructField):
        c = F.col(f.name)
        plain = isinstance(f.dataType, T.NumericType | T.BooleanType)
        return F.coalesce(c.cast("string") if plain else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *map(value, df.schema)), F.lit(");")).alias("sql"))


def jdbc_options(url: str) -> dict[str, str]:
    """dialect, host, port, database and parameters of a JDBC URL."""
    import re

    m = re.match(r"jdbc:(?:([a-z0-9]+):)(?:thin:@/{0,2}|//)?([^:/;?]+)?(?::(\d+))?(?:[/:]([^?;]*))?(?:[?;](.*))?$", url, re.I)
    if not m:
        raise ValueError(f"not a JDBC URL: {url}")
    kinds = {"postgresql": "postgres", "dm": "dameng", "hive2": "hive", "trino": "presto", "mariadb": "mysql", "ch": "clickhouse"}
    # Driver classes.
    drivers = {"mysql": "com.mysql.cj.jdbc.Driver", "postgres": "org.postgresql.Driver", "oracle": "oracle.jdbc.OracleDriver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "h2": "org.h2.Driver", "db2": "com.ibm.db2.jcc.DB2Driver", "sqlite": "org.sqlite.JDBC"}
    kind = kinds.get(m[1].lower(), m[1].lower())
    out = {"dialect": kind, "host": m[2] or "", "port": m[3] or "", "database": m[4] or "", "driver": drivers.get(kind, "")}
    for p in re.split(r"[&;]", m[5] or ""):
        if "=" in p:
            k, v = p.split("=", 1)
            out[k] = v
            if k.lower() == "databasename":
                out["database"] = v
    return out


def schema_changes(have: T.StructType, want: T.StructType, table: str) -> list[str]:
    """ALTER statements that add what is missing; a changed type is reported, not applied."""
    old = {f.name.lower(): f for f in have}
    out = [f"ALTER TABLE {table} ADD COLUMNS ({f.name} {f.dataType.simpleString()})" for f in want if f.name.lower() not in old]
    return out + [f"-- {f.name}: {old[f.name.lower()].dataType.simpleString()} is wanted as {f.dataType.simpleString()}" for f in want if f.name.lower() in old and old[f.name.lower()].dataType != f.dataType]


# --- rows of CSV


def row_map(df: DataFrame, out_col: str = "row") -> DataFrame:
    """One map a row: column name to text; empty fields are null."""
    names = [c for c in df.columns for _ in (0, 1)]
    pairs = [F.lit(c) if i % 2 == 0 else F.col(f"`{c}`").cast("string") for i, c in enumerate(names)]
    return df.select(F.create_map(*pairs).alias(out_col))


def without(df: DataFrame, place: int) -> DataFrame:
    """Without the column at a place, from 0."""
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if i != place))


def with_value(df: DataFrame, column: str, value, where: Column | None = None) -> DataFrame:
    """A column set to a value, in the rows that a condition selects."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, new if where is None else F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.col(f"`{column}`")))


def as_entities(df: DataFrame, entity: type) -> DataFrame:
    """Columns of a dataclass by name (case and underscores aside), cast to its types; fields that the file lacks are null."""
    from dataclasses import fields
    from typing import get_type_hints

    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary", "date": "date", "datetime": "timestamp", "Decimal": "decimal(38,18)"}
    hints = get_type_hints(entity)
    plain = {c.lower().replace("_", ""): c for c in df.columns}
    out = []
    for f in fields(entity):
        t = next((a for a in getattr(hints[f.name], "__args__", ()) if a is not type(None)), hints[f.name])
        kind = kinds.get(t) or kinds.get(getattr(t, "__name__", ""), "string")
        source = plain.get(f.name.lower().replace("_", ""))
        out.append((F.col(f"`{source}`").try_cast(kind) if source else F.lit(None).cast(kind)).alias(f.name))
    return df.select(*out)
