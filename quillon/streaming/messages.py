"""Server-sent events: text of an event stream as rows, and partial messages put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(lines: Column, name: str) -> Column:
    """The values of a field, in order; one space behind the colon doesn't count."""
    own = F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:")) | (x == name))
    return F.transform(own, lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))


def events(df: DataFrame, text_col: str) -> DataFrame:
    """The input's columns (without the text) and place, event, id, data: a row for each block that a blank line ends; comments and blocks without data are left out."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^\ufeff", ""), "\r\n|\r", "\n")
    blocks = df.withColumn("__blocks", F.split(text, "\n\n+")).select(*(c for c in df.columns if c != text_col), F.posexplode("__blocks").alias("place", "__block"))
    lines = F.filter(F.split("__block", "\n"), lambda x: ~F.startswith(x, F.lit(":")))
    out = blocks.withColumn("__lines", lines).withColumn("__data", _field(F.col("__lines"), "data")).where(F.size("__data") > 0)
    rest = [c for c in df.columns if c != text_col]
    return out.select(*rest, "place", F.coalesce(F.try_element_at(_field(F.col("__lines"), "event"), F.lit(-1)), F.lit("message")).alias("event"), F.try_element_at(_field(F.col("__lines"), "id"), F.lit(-1)).alias("id"), F.array_join("__data", "\n").alias("data"))


def merged(df: DataFrame, keys: list[str], order: str, part_col: str, out_col: str = "text") -> DataFrame:
    """One text a key: its parts in order. Null parts are empty."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(part_col), F.lit("")).alias("p"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias(out_col))
