"""Structured Streaming over events: windows, sessions, duplicates, and the stream-stream join WITHIN a span.

State is bounded by a watermark in every operator. run() drains a source once (availableNow) into a shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

LATE = "10 minutes"


def events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ts without zone is read as UTC."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str, keys: list[str], late: str = LATE) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"))


def hopping(df: DataFrame, size: str, step: str, keys: list[str], late: str = LATE) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, gap: str, keys: list[str], late: str = LATE) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def distinct_within(df: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def join_within(left: DataFrame, right: DataFrame, key: str, span: str, late: str = LATE) -> DataFrame:
    """Rows of right up to `span` after a row of left with an equal key. State is kept for span plus lateness."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.withWatermark("ts", late).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {span}"))


def run(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Drain the stream and return what it wrote, as files in a shared folder: nothing gathers on the driver.

    Each batch goes to a folder of its own, written whole or again, so a repeated batch changes nothing. In complete mode a batch holds all
    windows, and the last one counts.
    """
    spark = df.sparkSession
    at = f"{(folder or shared_dir(spark)).rstrip('/')}/stream-{uuid.uuid4().hex[:10]}"
    schema, last = df.schema, []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        last.append(number)

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(put).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{at}/out/batch={last[-1]}" if mode == "complete" else f"{at}/out/*")


def clause(text: str) -> dict:
    """WINDOW TUMBLING (SIZE 1 HOUR) / HOPPING (SIZE 1 HOUR, ADVANCE BY 15 MINUTES) / SESSION (30 MINUTES), as options."""
    import re

    m = re.match(r"\s*(?:WINDOW\s+)?(TUMBLING|HOPPING|SESSION)\s*\((.*)\)\s*$", text, re.I | re.S)
    if not m:
        raise ValueError(f"not a window clause: {text}")
    kind, body = m[1].upper(), m[2]
    spans = re.findall(r"(\d+)\s+([A-Za-z]+)", body)
    return {"kind": kind, "spans": [f"{n} {u.lower()}" for n, u in spans]}


def windowed(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    c = clause(text)
    return {"TUMBLING": tumbling, "HOPPING": hopping, "SESSION": sessions}[c["kind"]](df, *c["spans"], keys)
