"""Operators on the import graph: edges (src, dst) between files (file_id, module_name, ...)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rings import cycles, strong_components  # noqa: F401


def stats(files: DataFrame, classes: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, classes, functions, edges, total and code lines."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return f.crossJoin(one(classes, "classes")).crossJoin(one(functions, "functions")).crossJoin(one(edges, "edges"))  # of one row each


def labelled(edges: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends, as src_<column> and dst_<column>."""
    side = lambda k: files.select(F.col("file_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def imports_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of these files, duplicates kept."""
    return edges.join(files.select(F.col("file_id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("file_id"), F.col("dst").alias("imported"))


def imported_by(edges: DataFrame, files: DataFrame) -> DataFrame:
    return edges.join(files.select(F.col("file_id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("file_id"), F.col("src").alias("importer"))


def dependency_count(edges: DataFrame, files: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("n"))
    return files.select("file_id").join(out, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("dependency_count"))


def module_edges(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """Distinct pairs of different modules with an import from the one to the other; module_of: file_id, module."""
    both = labelled(edges, module_of, "module")
    return both.filter("src_module <> dst_module").select(F.col("src_module").alias("from_module"), F.col("dst_module").alias("to_module")).distinct()


def internal_edges(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """Edges with both ends in one module, not deduplicated."""
    return labelled(edges, module_of, "module").filter("src_module = dst_module").select(F.col("src_module").alias("module"), "src", "dst")


def filter_files(files: DataFrame, patterns: Iterable[str] = (), module: str = "module", project: DataFrame | None = None) -> DataFrame:
    """Files whose module matches one of the patterns, and, if `project` is given, that belong to it."""
    patterns = list(patterns)
    if project is not None:
        files = files.join(project.select("file_id").distinct(), "file_id", "left_semi")
    if not patterns:
        return files
    keep = S.glob_match(patterns[0], module)
    for p in patterns[1:]:
        keep = keep | S.glob_match(p, module)
    return files.filter(keep)


def inherits(classes: DataFrame, imports: DataFrame, files: DataFrame, compat: bool = False) -> DataFrame:
    """(src, dst): each class and the classes that its bases name.

    A base is looked up among the classes of its own file, else among the names that the file imports from files of the
    project, else, by its last part, among the classes whose name no other class of the project has.
    """
    from .resolve import import_edges

    own = classes.select(F.col("class_id").alias("src"), "file_id", F.posexplode("bases").alias("nth", "base"))
    own = own.withColumn("name", F.element_at(F.split("base", r"\."), -1))
    all_ = classes.select(F.col("class_id").alias("dst"), F.col("file_id").alias("in_file"), F.col("name").alias("class_name"))
    key = ["src", "nth"]
    here = own.join(all_, (F.col("file_id") == F.col("in_file")) & (F.col("name") == F.col("class_name")))
    open_ = own.join(here.select(*key).distinct(), key, "left_anti")
    names = imports.withColumn("n", F.explode("names")).withColumn("as_name", F.coalesce("n.alias", "n.name")).withColumn("its_name", F.col("n.name"))
    names = import_edges(names.drop("names", "n"), files, compat, ("as_name", "its_name")).withColumnsRenamed({"src": "importer", "dst": "imported"}).distinct()
    there = open_.join(names, (F.col("file_id") == F.col("importer")) & (F.col("name") == F.col("as_name"))).join(all_, (F.col("imported") == F.col("in_file")) & (F.col("its_name") == F.col("class_name")))
    left = open_.join(there.select(*key).distinct(), key, "left_anti")
    single = classes.groupBy(F.col("name").alias("class_name")).agg(F.max("class_id").alias("dst"), F.count("*").alias("same")).filter("same = 1")
    by_name = left.join(single, F.col("name") == F.col("class_name"))
    return here.select("src", "dst").unionByName(there.select("src", "dst")).unionByName(by_name.select("src", "dst")).filter("src <> dst").distinct()
