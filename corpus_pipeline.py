"""The corpus pipeline: quality rules, one of each group of near copies, repeated passages, mixing, packing.

Every stage gets the documents its predecessor kept, written as Parquet and read again; all but the last return them with
the columns of ``documents``. The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lessonlens.llm.jaccard_join import one_of_each
from lessonlens.llm.mixing import mix_documents
from lessonlens.llm.packing import pack_documents
from lessonlens.llm.quality_rules import keep_good
from lessonlens.llm.substring_dedup import without_repeats
from lessonlens.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no zstandard, no tokenizer and no best-fit packing; the tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
