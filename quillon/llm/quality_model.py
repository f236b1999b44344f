"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a fitted temperature.

Words are runs of one kind of byte: lower-cased letters, digits, one mark. A run of capitals counts as one word of its own
kind, and so does a word that repeats the word before it. Random indexing: each bucket of words has a fixed sparse vector of
+1 and -1; a bucket's word vector is its own plus those of its neighbours within two words, over all documents, to length one.
Means and mean squares of the word vectors are the network's input.

The word vectors are sums, added up over tasks in one scan of the whole corpus (a table of fixed size). The network is
fitted on the driver from a bounded, hash-chosen sample of labelled rows (terms.SAMPLE_PER_LABEL rows for each label, pooled on the executors; held-out
ids never); every document is scored, whole, in one narrow pass. Null and empty texts pool to zeros. Repeated rows score
alike. Without labelled rows of both labels nothing can be learnt and every score is 1. A null id counts as not held out. A column of the input that is named
as the score is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_column, blocks, hash_spans, held_out, read, runs, slices
from .models import TwoLayerNet
from .terms import KIND, SAMPLE_PER_LABEL, bounded, fold, sample

BITS, DIM, NONZERO, REACH = 14, 32, 4, 2
CAPITALS, REPEAT = 0, 1  # buckets of the two word kinds without a spelling
THRESHOLD = 0.3


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows) of all words in order."""
    starts, ends, rows = runs(KIND[data], off)
    if not len(starts):
        return np.zeros(0, np.int64), rows
    h = hash_spans(fold(data), starts, ends)
    b = (h >> np.uint64(64 - BITS)).astype(np.int64)
    b = np.maximum(b, 2)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals = (upper[ends] - upper[starts] == ends - starts) & (ends - starts >= 2)
    letters = KIND[data[starts]] == 1
    # The word before, over single marks: "x! x!" repeats too.
    w = np.flatnonzero(letters)
    again = np.zeros(len(b), bool)
    if len(w) > 1:
        again[w[1:]] = (h[w[1:]] == h[w[:-1]]) & (rows[w[1:]] == rows[w[:-1]])
    return np.where(again, REPEAT, np.where(capitals, CAPITALS, b)), rows


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    out = np.zeros((1 << BITS, DIM), np.float32)
    at = np.argsort(rng.random((1 << BITS, DIM)), 1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), 1)
    return out


def context_sums(buckets: np.ndarray, rows: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to out (buckets by dimensions, flat) the index vectors of each word's neighbours."""
    at, sign = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO], np.take_along_axis(index, np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO], 1)
    for step in range(1, REACH + 1):
        same = np.flatnonzero(rows[step:] == rows[:-step])
        left, right = buckets[same], buckets[same + step]
        for j in range(NONZERO):
            out += np.bincount(left * DIM + at[right, j], sign[right, j], out.size).astype(np.int64)
            out += np.bincount(right * DIM + at[left, j], sign[left, j], out.size).astype(np.int64)


PART = 1 << 8  # buckets of one part of the table of sums


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all buckets: sums over every document, one row a part from each task, added up by part."""

    def count(batches):
        index, out = index_vectors(), np.zeros((1 << BITS) * DIM, np.int64)
        for b in batches:
            for _, _, data, off in blocks(b.column("text")):
                context_sums(*word_buckets(data, off), index, out)
        parts = out.reshape(-1, PART * DIM)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].astype("<i8").tobytes() for i in some], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PART * DIM, np.int64)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer(), "<i8")
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, sums binary"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).toArrow()  # the table's fixed size
    total = index_vectors().reshape(-1, PART * DIM)
    for part, sums in zip(found.column("part").to_pylist(), found.column("sums"), strict=True):
        total[part] += np.frombuffer(sums.as_buffer(), "<i8")
    total = total.reshape(1 << BITS, DIM)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pool(table: np.ndarray, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Means over each row's words of the table's rows; zeros for a row without words."""
    out = np.zeros((n, table.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts = np.diff(np.append(first, len(rows)))
        out[rows[first]] = np.add.reduceat(table[buckets], first, axis=0) / counts[:, None]
    return out


class Model:
    def __init__(self, table: np.ndarray, net: TwoLayerNet):
        self.table, self.net = table, net

    def scores(self, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return self.net.predict(pool(self.table, buckets, rows, n))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    vectors = word_vectors(docs, text_col)
    table = np.concatenate([vectors, vectors**2], 1).astype(np.float32)
    handle = docs.sparkSession.sparkContext.broadcast(table)

    def pooled(batches):
        for b in slices(batches):
            out = []
            for lo, hi, data, off in blocks(b.column("text"), 1 << 18):
                out += [x.astype("<f4").tobytes() for x in pool(handle.value, *word_buckets(data, off), hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(out, pa.binary())], ["id", "y", "x"])

    found = sample(docs, labels, label, id_col, text_col, per_label)
    rows = found.mapInArrow(pooled, found.select("id", "y", F.lit(b"").alias("x")).schema)
    rows = bounded(rows, "x", per_label=per_label).toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("x", "ascending")])
    y = np.array(rows.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(v, "<f4") for v in rows.column("x").to_pylist()]).astype(float)
    return Model(table, TwoLayerNet(x.shape[1]).fit(x, y, apart=np.arange(len(y)) % 5 == 0))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The input's columns and out_col."""
    if model is None:
        return docs.withColumn(out_col, F.lit(1.0))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def scores(text):
        out = [np.zeros(0)]
        for lo, hi, data, off in blocks(text, 1 << 18):
            out.append(handle.value.scores(*word_buckets(data, off), hi - lo))
        return pa.array(np.concatenate(out), pa.float64())

    return add_column(docs, out_col, "double", scores, text_col)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
