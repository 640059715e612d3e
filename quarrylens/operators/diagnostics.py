"""Findings about open files: cycles, missing documentation, high complexity, many functions.

Codes, severities and messages are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as S

_NONE = "array<string>"


def _rows(df: DataFrame, severity: str, code: str, message, line=None, related=None) -> DataFrame:
    return df.select(
        "path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (line if line is not None else F.lit(0)).cast("int").alias("line"), message.alias("message"),
        (related if related is not None else F.array().cast(_NONE)).alias("related"))


def circular(cycle_members: DataFrame) -> DataFrame:
    """cycle_members: cycle_id, pos, path. Each member gets the whole ring as text, and the others as related."""
    ring = cycle_members.groupBy("cycle_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("ring"))
    names = F.transform("ring", lambda p: F.element_at(F.split(p, "/"), -1))
    text = F.concat(F.lit("Circular dependency detected: "), F.array_join(names, " -> "))
    each = ring.select("ring", F.explode("ring").alias("path"), text.alias("text"))
    return _rows(each, "ERROR", "circular-dependency", F.col("text"), related=F.filter("ring", lambda p: p != F.col("path")))


def findings(files: DataFrame, classes: DataFrame, metrics: DataFrame, cycle_members: DataFrame, open_files: DataFrame) -> DataFrame:
    """path, severity, code, line, message, related for every open file; one without findings keeps a row of nulls."""
    own = files.select("file_id", "path", "docstring")
    docs = _rows(own.filter(S.is_blank("docstring")), "HINT", "missing-module-docs", F.lit("Module is missing documentation"))
    c = classes.filter(S.is_blank("docstring")).select("file_id", "name", "line_start").join(own.select("file_id", "path"), "file_id")
    cls = _rows(c, "HINT", "missing-class-docs", F.concat(F.lit("Class '"), "name", F.lit("' is missing documentation")), line=F.greatest(F.col("line_start") - 1, F.lit(0)))
    m = metrics.select("file_id", "complexity", "function_count").join(own.select("file_id", "path"), "file_id")
    high = _rows(m.filter(F.col("complexity") > N.HIGH_COMPLEXITY), "WARNING", "high-complexity", F.format_string("High complexity detected (complexity: %d, threshold: %d). Consider splitting this module.", "complexity", F.lit(N.HIGH_COMPLEXITY)))
    many = _rows(m.filter(F.col("function_count") > N.MANY_FUNCTIONS), "WARNING", "too-many-functions", F.format_string("Too many functions in module (%d functions, threshold: %d). Consider splitting this module.", "function_count", F.lit(N.MANY_FUNCTIONS)))
    found = circular(cycle_members).unionByName(docs).unionByName(cls).unionByName(high).unionByName(many)
    return open_files.select("path").distinct().join(found, "path", "left")
