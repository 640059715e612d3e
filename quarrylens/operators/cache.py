"""Incremental analysis: what of a scan is still valid in a cache of parsed files."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

VERSION = "1"


def config_hash(spark: SparkSession, config) -> str:
    """SHA-256 of the configuration as JSON."""
    text = json.dumps(asdict(config) if is_dataclass(config) else config, sort_keys=True)
    return spark.range(1).select(S.content_hash(F.lit(text))).first()[0]


def split(scan: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a scan (path, mtime, content_hash): the same time, or else the same content."""
    c = cache.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"), F.col("content_hash").alias("__h"))
    both = scan.join(c, F.col("path") == F.col("__p"), "left")
    hit = F.coalesce((F.col("mtime") == F.col("__m")) | (F.col("content_hash") == F.col("__h")), F.lit(False))
    marked = both.withColumn("__hit", hit).drop("__p", "__m", "__h")
    return marked.filter("__hit").drop("__hit"), marked.filter("not __hit").drop("__hit")


def prune(cache: DataFrame, scan: DataFrame) -> DataFrame:
    """Cache rows whose file is still there."""
    return cache.join(scan.select("path").distinct(), "path", "left_semi")


def save(parsed: DataFrame, path: str, config: str, root: str) -> None:
    parsed.withColumns({"version": F.lit(VERSION), "config_hash": F.lit(config), "root": F.lit(root)}).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, config: str, root: str) -> DataFrame | None:
    """Rows that fit version, configuration and root; None where there is no cache."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # no such path: the first run
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return df.filter((F.col("version") == VERSION) & (F.col("config_hash") == config) & (F.col("root") == root)).drop("version", "config_hash", "root")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries")).withColumn("version", F.lit(VERSION))
