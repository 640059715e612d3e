"""Metrics of files, modules and the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

TOTALS = ("total_lines", "code_lines", "comment_lines", "class_count", "function_count", "import_count", "complexity")


def _count(name: str = "n") -> Column:
    return F.count("*").alias(name)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)


def import_metrics(resolved: DataFrame, key: str = "file_id") -> DataFrame:
    """Imports of each key by type: one pass, conditional counts."""
    of = lambda t: F.count_if(F.col("import_type") == t)
    return resolved.groupBy(key).agg(
        F.count("*").alias("imports_total"), of("Stdlib").alias("imports_stdlib"), of("ThirdParty").alias("imports_third_party"), of("Local").alias("imports_local"), of("Unknown").alias("imports_unknown"))


def file_metrics(files: DataFrame, classes: DataFrame, functions: DataFrame, constants: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """All metrics of every file; files without functions or classes keep their row.

    files: file_id and line counts; classes: file_id; functions: file_id, class_id (null: top level), name, line_start, line_end.
    """
    length = F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1
    fn = functions.groupBy("file_id").agg(
        _count("function_count"), F.count_if(F.col("class_id").isNull()).alias("top_level_function_count"), F.count("class_id").alias("method_count"),
        F.avg(length).alias("avg"), F.max(length).alias("max"), F.count_if(~S.is_private("name")).alias("public"))
    out = files.select("file_id", "total_lines", "code_lines", "comment_lines")
    out = out.join(classes.groupBy("file_id").agg(_count("class_count")), "file_id", "left").join(fn, "file_id", "left")
    if constants is not None:
        out = out.join(constants.groupBy("file_id").agg(_count("constant_count")), "file_id", "left")
    else:
        out = out.withColumn("constant_count", F.lit(0))
    kinds = ("imports_total", "imports_stdlib", "imports_third_party", "imports_local", "imports_unknown")
    out = out.join(import_metrics(resolved), "file_id", "left") if resolved is not None else out.withColumns(dict.fromkeys(kinds, F.lit(0)))
    counts = ("class_count", "function_count", "top_level_function_count", "method_count", "constant_count", *kinds)
    return out.select(
        "file_id", "total_lines", "code_lines", "comment_lines", F.greatest(F.col("total_lines") - F.col("code_lines") - F.col("comment_lines"), F.lit(0)).cast("long").alias("blank_lines"),
        *[_zero(c) for c in counts], F.coalesce("avg", F.lit(0.0)).alias("avg_function_length"), F.coalesce("max", F.lit(0)).cast("long").alias("max_function_length"),
        F.coalesce(F.col("public") / F.col("function_count"), F.lit(1.0)).alias("public_ratio"), (F.coalesce("function_count", F.lit(0)) + F.coalesce("class_count", F.lit(0))).cast("long").alias("complexity"))


def module_metrics(module_files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sums, and integer averages over the module's files. module_files: module, file_id; metrics with TOTALS."""
    both = module_files.join(metrics, "file_id", "left")
    out = both.groupBy("module").agg(_count("file_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])
    return out.select("module", "file_count", *TOTALS, *[F.expr(f"{c} div file_count").alias(f"avg_{c}") for c in TOTALS])


def project_metrics(metrics: DataFrame) -> DataFrame:
    """One row for the project; the average function length is the mean of the files' means."""
    imports = [c for c in ("imports_stdlib", "imports_third_party", "imports_local", "imports_unknown") if c in metrics.columns]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return metrics.agg(
        _count("file_count"), *[total(c).alias(c if c != "complexity" else "total_complexity") for c in TOTALS], *[total(c).alias(c) for c in imports],
        F.coalesce(F.max("total_lines"), F.lit(0)).alias("max_file_size"), F.coalesce(F.avg("total_lines"), F.lit(0.0)).alias("avg_file_size"),
        F.coalesce(F.avg(F.when(F.col("function_count") > 0, F.col("avg_function_length"))), F.lit(0.0)).alias("avg_function_length"),
        F.when(total("code_lines") > 0, total("comment_lines") / total("code_lines")).otherwise(0.0).alias("comment_ratio"))


def module_page_stats(module_files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Files, lines, classes and functions of each module."""
    c, f = classes.groupBy("file_id").agg(_count("c")), functions.groupBy("file_id").agg(_count("f"))
    both = module_files.join(c, "file_id", "left").join(f, "file_id", "left")
    return both.groupBy("module").agg(_count("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("classes"), F.coalesce(F.sum("f"), F.lit(0)).alias("functions"))
