"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.chat import CHAT_SQL, rotate_perspectives
from factorloom.llm.common import crc_mod, shared_dir
from factorloom.llm.decontamination import DECONTAMINATION_SQL, decontaminate
from factorloom.llm.fingerprints import fingerprint_documents
from factorloom.llm.infilling import INFILLING_SQL, fill_in_middle, restored
from factorloom.llm.langid import fit_languages, language_ids
from factorloom.llm.mixing import mix_sources
from factorloom.llm.quality import fit_quality, quality_scores
from factorloom.llm.sharding import shard_documents
from factorloom.llm.simhash import simhash_groups
from factorloom.llm.suffixes import remove_repeats
from factorloom.llm.token_counts import token_counts
from factorloom.llm.warc import WARC_SQL, read_warc, write_warc
from factorloom.llm.whitening import fit_whitening, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def learnt_from(column: str) -> Column:
    """Ids whose quality labels may be learnt from."""
    return crc_mod(column, 3) != 1


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents, table(spark, sf_dir, "labels"), learnt_from)
    return quality_scores(documents, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    languages = fit_languages(documents, crc_mod("doc_id", 5) != 0)
    return language_ids(documents, languages).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "proportions")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("row_key")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.withColumns({"output_sha256": digest(F.col("output")), "restored_sha256": digest(restored(F.col("output"), F.col("form")))}).drop("output")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whiten(embeddings, fit_whitening(embeddings))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    back = read_warc(spark, folder, payload=False)
    return back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_langid": op3_langid,
    "op4_sharding": op4_sharding,
    "op5_fingerprints": op5_fingerprints,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {"op9_decontamination": DECONTAMINATION_SQL, "op10_chat": CHAT_SQL, "op11_fill_in_middle": INFILLING_SQL, "op13_warc": WARC_SQL}
