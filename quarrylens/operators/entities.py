"""Relations from parsed files: files, classes, functions, imports, constants, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..session import cut


def number(df: DataFrame, name: str, *order) -> DataFrame:
    """Dense numbers from 0 in the given order, without one task that holds all rows.

    Rows are range-partitioned in that order; counts of the partitions before are added to the number inside. The
    partitioned rows are written once: a second evaluation would draw another sample and so other ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))  # a row for each partition
    return ranged.withColumn("__r", inside).join(starts, "__p").withColumn(name, (F.col("__r") + F.col("__s") - 1).cast("long")).drop("__p", "__r", "__s")


def files(parsed: DataFrame) -> DataFrame:
    """Files that parsed, numbered in the order of their paths."""
    return number(parsed.filter("error is null"), "file_id", F.split("rel_path", "/"), F.col("rel_path"))


def classes(numbered: DataFrame) -> DataFrame:
    c = numbered.select("file_id", F.posexplode("classes").alias("ordinal", "c")).select("file_id", "ordinal", "c.*")
    return number(c, "class_id", F.col("file_id"), F.col("ordinal"))


def functions(numbered: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Methods of a file's classes come before its top-level functions."""
    m = class_rows.select("file_id", "class_id", F.col("ordinal").alias("__c"), F.posexplode("methods").alias("ordinal", "f"))
    t = numbered.select("file_id", F.lit(None).cast("long").alias("class_id"), F.lit(1 << 30).alias("__c"), F.posexplode("functions").alias("ordinal", "f"))
    f = m.unionByName(t).select("file_id", "class_id", "__c", "ordinal", "f.*")
    f = f.withColumn("signature", S.signature("is_async", "name", "parameters", "return_type"))
    return number(f, "function_id", F.col("file_id"), F.col("__c"), F.col("ordinal")).drop("__c")


def imports(numbered: DataFrame) -> DataFrame:
    return numbered.select("file_id", F.col("rel_path").alias("path"), F.posexplode("imports").alias("ordinal", "i")).select("file_id", "path", "ordinal", "i.*")


def constants(numbered: DataFrame) -> DataFrame:
    return numbered.select("file_id", F.explode("constants").alias("k")).select("file_id", "k.*")


def attributes(class_rows: DataFrame) -> DataFrame:
    return class_rows.select("class_id", F.explode("attributes").alias("a")).select("class_id", "a.*")
