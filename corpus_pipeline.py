"""The corpus pipeline: documents through five operators, each stage's rows written and read again.

All stages but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, packing, prob_minhash, secret_scan
from millrace.llm.common import materialize, release, sized, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know, surely enough; those that are rejected go."""
    return sized(language_id.keep_known(docs, language_id.fit(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return sized(prob_minhash.keep_one(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark."""
    return sized(decontaminate.drop(docs, table(spark, sf_dir, "benchmark")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars counted anew where any was."""
    return sized(secret_scan.redacted(docs, secret_scan.ledger_of(spark, sf_dir)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequence and place."""
    return sized(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")), docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", packed)]

#: Language models, classes and packings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, a stage's own tables let go once its rows are written. Ids are left out of the result as their checksum is in it."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, wide=True)
        release(since, docs)
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
