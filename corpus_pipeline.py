"""A training corpus from `documents`: the stages, each an operator of topicspark.llm.

Each stage takes (session, its predecessor's rows, folder of the tables) and works on all of them. All but the last
return the columns of `documents`; the last returns (doc_id, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from topicspark.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from these documents."""
    return langid.identified(docs, langid.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that resemble an earlier one."""
    return line_dedup.without_similar_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity of 0.8."""
    return near_dedup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passages."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they give back."""
    done = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination), ("bpe", encoding),
]
#: A trained classifier is among the stages, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
