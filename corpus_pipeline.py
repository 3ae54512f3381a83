"""The corpus pipeline: stages that each take what the stage before kept.

language_id   documents that are in no learned language go
minhash_dedup of each group of near copies (five words, similarity 0.8) the first document stays
secret_scan   secrets are replaced by a label; n_chars follows
mixing        documents are taken as often as their source's target weight says
bpe           tokens of each document that is left, with digests of ids and of the decoded bytes
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, minhash, mixing, secret_scan
from tidemark.llm.common import fresh
from tidemark.plans.storage import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_a_language(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (before,) = fresh(docs.columns, "_n")
    out = secret_scan.redacted(docs.withColumn(before, F.length("text")))
    moved = F.length("text") - F.col(before)
    return out.withColumn("n_chars", (F.col("n_chars") + F.coalesce(moved, F.lit(0))).cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("secret_scan", secrets), ("mixing", mix), ("bpe", tokens)]
#: Languages, minhashes and tokens are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
