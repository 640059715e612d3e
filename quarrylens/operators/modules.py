"""Modules: files grouped by directory, their kinds and their coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def parent(path: str):
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "^$", "")


def membership(files: DataFrame) -> DataFrame:
    """file_id, path, module, dir of every file."""
    d = parent("path")
    return files.select("file_id", "path", F.when(d == "", "root").otherwise(F.replace(d, F.lit("/"), F.lit("."))).alias("module"), d.alias("dir"))


def detect(files: DataFrame, min_files: int = 1) -> DataFrame:
    """One row for each directory with enough files, sorted by the parts of its path."""
    m = membership(files)
    name = F.element_at(F.split("path", "/"), -1)
    out = m.groupBy("module", F.col("dir").alias("path")).agg(F.count("*").alias("file_count"), F.bool_or(name == "__init__.py").alias("is_package"))
    last = F.element_at(F.split("path", "/"), -1)
    return out.filter(F.col("file_count") >= min_files).withColumn("module_type", S.module_type(last)).orderBy(F.split("path", "/"))


def find_root_modules(modules: DataFrame) -> DataFrame:
    return modules.filter(~F.col("module").contains(".") & (F.col("module") != "root"))


def find_by_type(modules: DataFrame, module_type: str) -> DataFrame:
    return modules.filter(F.col("module_type") == module_type)


def stats(modules: DataFrame) -> DataFrame:
    """One row: modules, packages, average files, most coupling, and the histogram of types as a map."""
    by = modules.groupBy("module_type").agg(F.count("*").alias("n"))  # of nine types at most
    hist = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("module_type", "n")))).alias("by_type"))
    coupling = F.col("outgoing_imports") + F.col("incoming_imports") if "outgoing_imports" in modules.columns else F.lit(0)
    one = modules.agg(
        F.count("*").alias("total"), F.count_if("is_package").alias("packages"), F.coalesce(F.avg("file_count"), F.lit(0.0)).alias("avg_files"), F.coalesce(F.max(coupling), F.lit(0)).alias("max_coupling"))
    return one.crossJoin(hist)  # of one row each


def coupling(members: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules imported by and importing each module. members: module, file_id, path; imports: file_id, module.

    An import names a path, that path with `.py`, or a package's `__init__.py`: three keys, one equi-join.
    """
    p = F.replace("name", F.lit("."), F.lit("/"))
    keys = F.array(p, F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))
    wanted = imports.select("file_id", F.col("module").alias("name")).join(members.select("file_id", F.col("module").alias("source")), "file_id").select("source", F.explode(F.array_distinct(keys)).alias("path")).distinct()
    pairs = wanted.join(members.select("path", F.col("module").alias("target")), "path").filter("source <> target").select("source", "target").distinct()
    size = members.groupBy("module").agg(F.count("*").alias("file_count"))
    out = pairs.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("outgoing_imports"))
    inc = pairs.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("incoming_imports"))
    both = size.join(out, "module", "left").join(inc, "module", "left").select("module", "file_count", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outgoing_imports", "incoming_imports")])
    return both.withColumn("coupling_score", (F.col("outgoing_imports") + F.col("incoming_imports")) / F.col("file_count"))
