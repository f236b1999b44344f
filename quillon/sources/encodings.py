"""Text encodings of raw bytes: a mark at the start, strict UTF-8, else the pattern of zero bytes or of double-byte pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Byte order marks, longest first.
MARKS = ((b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE"))


def detect(data: bytes) -> str:
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if not data:
        return "UTF-8"
    head = data[:4096]
    if head.count(0) > len(head) // 4:
        return "UTF-16BE" if head[::2].count(0) > head[1::2].count(0) else "UTF-16LE"
    try:
        data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    try:
        text = data.decode("gb18030")
        wide = sum("一" <= c <= "鿿" for c in text)
        if wide * 2 >= sum(b >= 0x80 for b in data) * 0.8:
            return "GB18030"
    except UnicodeDecodeError:
        pass
    return "ISO-8859-1"


def decode(data: bytes) -> str:
    name = detect(data)
    mark = next((m for m, n in MARKS if n == name and data.startswith(m)), b"")
    return data[len(mark) :].decode(name, "replace")


def decode_column(data: Column | str) -> Column:
    """struct<encoding, text>, in Arrow batches."""

    @F.pandas_udf("struct<encoding:string,text:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else (detect(bytes(b)), decode(bytes(b))) for b in s], columns=["encoding", "text"])

    return run(data if isinstance(data, Column) else F.col(data))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, text of whole files of any encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_column("content").alias("d")).select("path", "d.*")
