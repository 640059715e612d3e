"""Training-data pipeline over `documents`: five stages, each by one operator of quarrylens.llm.

Every stage but the last returns the columns of `documents`. Quality rules drop documents and failed lines; of each
class of near duplicates the least doc_id stays; repeated 100-byte strings go; the mix repeats or drops documents so
that sources meet their targets; the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import op1_line_quality, op4_sentencepiece, op5_jaccard_join, op6_suffix_dedup, op9_mixing
from quarrylens.llm.common import checkpointed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_jaccard_join.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_suffix_dedup.clean(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_mixing.repeat(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_sentencepiece.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The rounding draws and the subword model have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written once before the next reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
