"""Operators that Spark SQL lacks, as compositions of DataFrame operations."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.parser import parse_expr
from ..sources.shared import shared_dir
from .matching import match_rows


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, str], pattern: str, measures: dict[str, str], all_rows: bool = False) -> DataFrame:
    """MATCH_RECOGNIZE from parts: define and measures are Spark SQL, such as {"V": "event_type = 'view'"} and {"views": "COUNT(V.*)"}."""
    from ..plans.emit import Emitter

    parsed = [(name, parse_expr(text, "spark")) for name, text in measures.items()]
    return match_rows(df, partition, order, {k.upper(): v for k, v in define.items()}, pattern, parsed, all_rows, em=Emitter("spark"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row at or before it. One union and one window: no pairs are made."""
    marked = left.withColumns({"__t": F.col(left_on), "__side": F.lit(1)})
    other = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(F.lit(True).alias("hit"), *columns).alias("__r"))
    rows = marked.withColumn("__r", F.lit(None).cast(other.schema["__r"].dataType)).unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *(F.col(f"__last.{c}").alias(f"asof_{c}" if c in left.columns else c) for c in columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace rows of target with equal keys; the new state of the table."""
    return target.join(source, keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def update(target: DataFrame, where: Column, assignments: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in target.columns))


def delete(target: DataFrame, where: Column) -> DataFrame:
    """A condition that is null deletes nothing."""
    return target.where(~F.coalesce(where, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_with: dict[str, str] | None = None, delete_when: Column | None = None, insert: bool = True) -> DataFrame:
    """The state of target after MERGE: matched rows take update_with (column -> source column) or go, others of source come in.

    Several source rows for one key that the target has are an error, as the clause demands; keys are counted before they meet the target.
    """
    twice = source.groupBy(*keys).agg(F.count("*").alias("__times")).where("__times > 1").select(*(F.col(k).alias(f"__d_{k}") for k in keys), F.lit(True).alias("__twice"))
    t = target.withColumn("__own", F.lit(True)).join(twice, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__d_{k}") for k in keys)), "left")
    t = t.withColumn("__own", F.when(F.col("__twice"), F.raise_error(F.lit("MERGE: several source rows change one row")).cast("boolean")).otherwise(F.col("__own")))
    s = source.select(*(F.col(c).alias(f"__s_{c}") for c in source.columns), F.lit(True).alias("__hit"))
    cond = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__s_{k}") for k in keys))
    rows = t.join(s, cond, "full" if insert else "left")
    if delete_when is not None:
        rows = rows.where(~(F.coalesce(F.col("__hit") & F.col("__own"), F.lit(False)) & F.coalesce(delete_when, F.lit(False))))
    out = []
    for c in target.columns:
        new = F.col(f"__s_{(update_with or {}).get(c, c)}") if (update_with or {}).get(c, c) in source.columns else F.lit(None)
        old = F.col(c)
        matched = new if c in (update_with or {}) else old
        out.append(F.when(F.col("__own").isNull(), new).when(F.col("__hit").isNull(), old).otherwise(matched).alias(c))
    return rows.select(*out)


def skyline(df: DataFrame, prefer: dict[str, str]) -> DataFrame:
    """Rows that no other row is at least as good as in all and better in one of the preferred columns ("low" or "high").

    Each task keeps the skyline of its rows, which is small, and the few that are left are compared in one task: no pairs of all rows are made.
    Rows with a null preference are never better than others and stay only if nothing beats them in what they have: they are left out, as by SQL's comparisons
    nothing beats them either, so they are added back as they are.
    """
    cols, signs = list(prefer), np.array([1.0 if v == "low" else -1.0 for v in prefer.values()])

    def best(x: np.ndarray) -> np.ndarray:
        """Places of the rows that no other row dominates; sorted by sum, a row can only be beaten by one before it."""
        order = np.argsort(x.sum(1), kind="stable")
        kept: list[int] = []
        front = np.empty((0, x.shape[1]))
        for i in order:
            if not len(front) or not ((front <= x[i]).all(1) & (front < x[i]).any(1)).any():
                kept.append(int(i))
                front = np.concatenate([front, x[i : i + 1]])
        return np.array(sorted(kept), np.int64)

    def local(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if table.num_rows:
                x = np.stack([np.asarray(table.column(c).cast(pa.float64())) for c in cols], 1) * signs
                held = table.take(best(x))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
    one = df.where(known).mapInArrow(local, df.schema).coalesce(1).mapInArrow(local, df.schema)
    return one.unionByName(df.where(~known))


def insert_first(source: DataFrame, branches: list[tuple[Column, str]], first: bool = True) -> dict[str, DataFrame]:
    """INSERT FIRST or ALL WHEN …: the rows of each branch; with first, a row goes to its first branch only."""
    out, before = {}, F.lit(False)
    for cond, name in branches:
        hit = F.coalesce(cond, F.lit(False))
        out[name] = source.where(hit & ~before if first else hit)
        before = before | hit
    return out


def prefix(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """The input's columns and place (the row's number in the order), rows (of all), and with a value running (its sum up to the row) and total.

    What a window without partition does in one task is done by many: rows are spread by ranges of the order and written, each range is numbered and
    summed by itself, and the ranges' own counts and sums (one row a range) are added up before them. The order must be total.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/prefix-{uuid.uuid4().hex[:12]}"
    spread = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    spread.write.parquet(at)
    rows = spark.read.schema(spread.schema).parquet(at)
    x = F.col(value) if value else F.lit(0)
    sums = rows.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(x).alias("__s"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sums = sums.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(before).alias("__had"), F.sum("__n").over(Window.partitionBy()).alias("rows"), F.sum("__s").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(sums), "__range")
    made = {"place": F.count("*").over(inside) + F.col("__before")} | ({"running": F.sum(x).over(inside) + F.coalesce("__had", F.lit(0))} if value else {})
    return out.withColumns(made).select(*df.columns, "place", "rows", *["running", "total"] * bool(value))


def ntile(place: Column, rows: Column, k: int) -> Column:
    """Which of k tiles a place falls into; the first tiles are larger by one where rows don't divide."""
    base, extra = F.floor(rows / k), rows % k
    head = extra * (base + 1)
    return F.when(place <= head, F.ceil(place / (base + 1))).otherwise(extra + F.ceil((place - head) / base)).cast("int")


def densify(facts: DataFrame, by: list[str], dimension: DataFrame, on: list[str]) -> DataFrame:
    """Partitioned outer join: every key of `by` gets a row for every row of the (small) dimension."""
    return facts.select(*by).distinct().join(dimension.select(*on).distinct(), how="cross").join(facts, [*by, *on], "left")


def similar_regex(pattern: str) -> str:
    return "^(?:" + re.sub(r"[%_]", lambda m: {"%": ".*", "_": "."}[m[0]], pattern) + ")$"
