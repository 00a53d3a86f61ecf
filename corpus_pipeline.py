"""The training-data pipeline: documents -> clean, distinct, mixed, packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents. Each stage is one of the
operators of ``tomelight.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomelight.llm._common import materialize
from tomelight.llm.exact_dedup import drop_exact_copies
from tomelight.llm.minhash_dedup import drop_near_copies
from tomelight.llm.mixing import mixed_documents
from tomelight.llm.packing import pack
from tomelight.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labelled ones, doesn't reject."""
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return drop_exact_copies(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; a document taken twice is two rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids (unsigned 32-bit, little-endian)."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_dedup", minhash_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
