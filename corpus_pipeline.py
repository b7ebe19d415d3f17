"""A training-data pipeline: each stage reads what the one before it wrote.

quality classifier, MinHash near-dedup, secret scan, source mixing, packing. All but the last return
the columns of ``documents``; the last returns pieces with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import minhash_forest, mixing, packing_binary, quality_qda, secret_scan
from dugout.llm.store import kept

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_qda.accepted(docs, labels, quality_qda.remainder(F.col("doc_id"), 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_forest.without_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their target weights."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power-of-two length, none across documents."""
    return packing_binary.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack),
]
ORACLE_SQL = None  # fitted scores, confirmed similarity and token ids have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
