"""Hashed terms of texts, for the classifiers, and the bounded sample of labelled rows that they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_spans, held_out, runs

SAMPLE_PER_LABEL = 4000  # labelled rows of each label that a classifier is fitted on, at most

# Kinds of bytes: letters (also all bytes of non-ASCII characters), digits, and each mark on its own; white space is 0.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = np.arange(33, 127)
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 capitals (second bytes 80 to 9E behind C3)."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the lower-cased letter runs."""
    starts, ends, rows = runs((KIND[data] == 1).astype(np.uint8), off)
    return hash_spans(fold(data), starts, ends), rows


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(id, y, text) of at most per_label ids of each label, held-out ids excepted, chosen by a hash of the id.

    Each top list is kept by every task and merged (no shuffle of the labels); its size is bounded, so it may be broadcast.
    Null ids and labels are left out; an id with both labels counts for both. An id may have many rows: see `bounded`.
    """
    good = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & ~held_out("id"))
    chosen: DataFrame | None = None
    for y in (0, 1):
        top = good.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = top if chosen is None else chosen.unionByName(top)
    texts: Column = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), texts.alias("text")).join(F.broadcast(chosen.dropDuplicates()), "id")


def bounded(rows: DataFrame, *order: str, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """At most per_label rows of each label y of what `sample` found, also where ids are repeated; each task keeps only such a top list."""
    top = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", *order).limit(per_label) for y in (0, 1)]
    return top[0].unionByName(top[1])
