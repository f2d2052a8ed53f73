"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns of ``docs``. A stage works on
what its predecessor kept, written as Parquet and read again. Null texts count as empty texts, repeated
rows as copies, other columns are carried along, and an empty table passes through. Of near-duplicates the one with the least id
stays, then the one with the least text hash; other ties are decided by hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialise
from factorloom.llm.decontamination import decontaminate
from factorloom.llm.mixing import mixed_documents
from factorloom.llm.quality import fit_quality, quality_scores
from factorloom.llm.queries import learnt_from, table
from factorloom.llm.sharding import shard_documents
from factorloom.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learnt_from)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return quality_scores(rows, model, keep=("row",)).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=("row",)).where("not contaminated").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the classifier, the links' components or the label propagation
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
