"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, ngram_join, packing, quality_rules, toxicity
from quillon.llm.common import Scratch, bound_batches, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the classifier is fitted on the labelled rows among docs."""
    bound_batches(spark)
    return toxicity.keep_civil(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for; labelled rows give the domains."""
    bound_batches(spark)
    ids = read(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")
    return mixing.resample(docs, labelled)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    bound_batches(spark)
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [("quality rules", quality), ("toxicity", civil), ("near duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Classifiers and the packing plan aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{i}")
            if i:
                scratch.drop(f"stage-{i - 1}")
    return docs
