"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased letter runs, hashed into buckets; a document has each bucket once. The pairwise part learns that two
terms together mean more than the sum of both, also where neither means anything alone. Fitted on the driver from a bounded, hash-chosen sample of labelled rows
(terms.SAMPLE_PER_LABEL rows for each label, MOST_TERMS buckets of a row, those of the least hash; held-out ids never); every document is scored, whole, in one narrow pass.

Null and empty texts have no terms and score the bias alone. Repeated rows score alike. Without any labelled rows of both
labels nothing can be learnt and every score is 0. A null id is scored and counts as not held out. A column of the input that is named as the score is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_column, blocks, held_out, lean, plain_names, read, slices
from .models import FactorizationMachine, sigmoid
from .terms import SAMPLE_PER_LABEL, bounded, sample, term_hashes

BITS = 18
THRESHOLD = 0.5
MOST_TERMS = 8192  # buckets of a row in the sample


def doc_terms(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, buckets): each bucket once for a row, rows ascending."""
    h, rows = term_hashes(data, off)
    keys = np.unique((rows.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def _pack(batches):
    for b in slices(batches):
        out = []
        for lo, hi, data, off in blocks(b.column("text")):
            rows, feats = doc_terms(data, off)
            cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
            feats = feats.astype("<u4")
            out += [feats[cuts[i] : min(cuts[i + 1], cuts[i] + MOST_TERMS)].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(out, pa.binary())], ["id", "y", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_PER_LABEL) -> FactorizationMachine | None:
    found = sample(docs, labels, label, id_col, text_col, per_label)
    rows = found.mapInArrow(lean(_pack), found.select("id", "y", F.lit(b"").alias("terms")).schema)
    rows = bounded(rows, "terms", per_label=per_label).toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("terms", "ascending")])
    y = np.array(rows.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return None
    terms = [np.frombuffer(x, "<u4") for x in rows.column("terms").to_pylist()]
    at = np.repeat(np.arange(len(y)), [len(x) for x in terms])
    return FactorizationMachine(1 << BITS).fit(at, np.concatenate(terms).astype(np.int64), y)


def score(docs: DataFrame, model: FactorizationMachine | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The input's columns and out_col. The text goes to Python with the rest of the row, once; no shuffle."""
    if model is None:
        return docs.withColumn(out_col, F.lit(0.0))
    # Only buckets with weights travel: sorted buckets, weights and factors.
    kept = np.flatnonzero(model.seen)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    small = FactorizationMachine(len(kept))
    small.w0, small.w, small.v = model.w0, model.w[kept], model.v[kept]
    handle = docs.sparkSession.sparkContext.broadcast((place, small))

    def scores(text):
        place, small = handle.value
        out = [np.zeros(0)]
        for lo, hi, data, off in blocks(text, 1 << 20):
            rows, feats = doc_terms(data, off)
            at = place[feats]
            out.append(sigmoid(small.raw(rows[at >= 0], at[at >= 0], hi - lo)))
        return pa.array(np.concatenate(out), pa.float64())

    return add_column(docs, out_col, "double", scores, text_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the input's columns."""
    plain, back = plain_names(docs)
    scored = score(plain, fit(docs, labels), plain.columns[docs.columns.index("text")], "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).select(*back)
