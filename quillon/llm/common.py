"""Shared pieces of the training-data operators: shared-folder tables, byte-level text scanning, hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # a word, in every operator
BLOCK_BYTES = 1 << 19  # text bytes that one vectorised step works on; its arrays hold several 8-byte numbers for each
BATCH_BYTES = 1 << 22  # of a batch that Spark sends to Python, where bound_batches() was called

_U = np.uint64
_POW_BASE = 0x9E3779B97F4A7C55


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a new temporary folder on a local master (tests), and an error on a cluster, whose machines share no such folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables that one run writes in the shared folder, so that lineage is cut and a lost executor costs only its own tasks.

    drop() removes what no later step reads. What the returned DataFrame reads stays until the session's Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:  # not stopped
                self.drop("")
        except (Py4JError, OSError):  # the JVM went first
            pass

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}".rstrip("/"))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on, batches that the session sends to Python hold about BATCH_BYTES at most, or the session's own bound if that is lower.

    Spark's own bound is 64 MB. A batch is held in the JVM beside the heap, as vectors and as their stream, and in Python once more, by each
    task. No result depends on how rows are dealt to batches. It stays set, as what a stage returns is computed later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(name).strip().lower()  # a number of bytes, with or without a unit
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(found)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, whose worker keeps no freed memory when a task is over: workers outlive tasks and wait beside the JVM through stages without Python."""

    def tidy(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own allocator keeps what is freed
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def plain_names(df: DataFrame) -> tuple[DataFrame, list]:
    """The table with columns c0, c1, … that no helper column clashes with, and what selects the old names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [F.col(n).alias(old) for n, old in zip(names, df.columns, strict=True)]


def add_column(df: DataFrame, out_col: str, kind: str, compute: Callable[..., pa.Array], *needed: str, rows: int = 10000) -> DataFrame:
    """The input's columns and out_col = compute(the needed columns), in one narrow pass.

    The whole row goes along, so no join is needed. A column of the input that has the name of out_col (case aside) is replaced.
    """
    plain, back = plain_names(df)
    at = [df.columns.index(c) for c in needed]
    kept = [c for c, old in zip(back, df.columns, strict=True) if old.lower() != out_col.lower()]

    def run(batches):
        for b in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([*b.columns, compute(*(b.column(i) for i in at))], [*b.schema.names, "added"])

    out = plain.mapInArrow(lean(run), plain.withColumn("added", F.lit(None).cast(kind)).schema)
    return out.select(*kept, F.col("added").alias(out_col))


def held_out(col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0. A null id: false."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- text as bytes -----------------------------------------------------------------------------------------------


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column and each row's bounds in them; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, arr.offset + len(arr) + 1)[arr.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(arr: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds from 0) with about `most` bytes each; one longer row is a block of its own."""
    data, off = bytes_of(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n), data[off[lo] : off[min(hi, n)]], off[lo : min(hi, n) + 1] - off[lo]
        lo = min(hi, n)


def slices(batches, rows: int = 500, most: int = 1 << 26):
    """Smaller batches: at most `rows` rows, and about `most` bytes if the rows are of like size."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * most // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def runs(kinds: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind inside a row: starts, ends, rows."""
    n = len(kinds)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:n])
    cut[off] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    real = kinds[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the hash are usable."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), _U)
    out[0] = 1
    out[1:] = _POW_BASE
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span's bytes. Spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    pos = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    powers = _POW if int(lengths.max()) <= len(_POW) else _powers(int(lengths.max()))
    values = (data[pos + np.repeat(starts, lengths)].astype(_U) + _U(1)) * powers[pos]
    return mix(np.add.reduceat(values, first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
NOT_SPACE = 1 - SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row: starts, ends, rows."""
    return runs(NOT_SPACE[data], off)
