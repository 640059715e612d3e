"""Classification and resolution of imports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import scalars as S


def _target(base: Column, module: Column) -> Column:
    return F.when(module == "", base).when(base == "", module).otherwise(F.concat(base, F.lit("/"), module))


def classify(imports: DataFrame, files: DataFrame, stdlib: Iterable[str] = N.STDLIB, third_party: Iterable[str] = ()) -> DataFrame:
    """import_type, resolved_module and resolved_path of every import.

    imports: file_id, path (of the importing file), module, kind, level, ...; files: path of all known files. Order of
    the rules: relative, standard library, known third party, local (`x.py`, else `x/__init__.py`), third party.
    """
    parts = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    parts = F.filter(parts, lambda x: x != "")
    up = F.greatest(F.coalesce("level", F.lit(1)) - 1, F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)).cast("int")), "/")
    as_path = F.replace("module", F.lit("."), F.lit("/"))
    relative = F.col("kind") == "Relative"
    own = imports.withColumn("__rel", relative).withColumn("__path", F.when(relative, _target(base, as_path)).otherwise(as_path))
    known = files.select("path").distinct()
    side = lambda name: known.select(F.col("path").alias(name))
    out = own.join(side("__file"), F.concat("__path", F.lit(".py")) == F.col("__file"), "left")
    out = out.join(side("__package"), F.concat("__path", F.lit("/__init__.py")) == F.col("__package"), "left")
    out = out.withColumn("found", F.coalesce("__file", "__package"))
    third = list(third_party)
    std = S.is_stdlib("module", stdlib)
    known_third = S.top_level("module").isin(*third) if third else F.lit(False)
    here = F.col("found").isNotNull()
    kind = (
        F.when(F.col("__rel"), F.when(here, "Local").otherwise("Unknown")).when(std, "Stdlib").when(known_third, "ThirdParty").when(here, "Local").otherwise("ThirdParty")
    )
    local = kind == "Local"
    name = F.replace("__path", F.lit("/"), F.lit("."))
    keep = [F.col(c) for c in imports.columns]
    return out.select(*keep, kind.alias("import_type"), F.when(local, name).otherwise(F.when(F.col("__rel"), F.lit(None)).otherwise(F.col("module"))).alias("resolved_module"), F.when(local, F.col("found")).alias("resolved_path"))


def target_module(module_name: Column, module: Column, kind: Column, level: Column, is_package: Column, compat: bool = False) -> Column:
    """Dotted name that an import points to. `compat` keeps the loss of relative imports whose base is empty."""
    parts = F.filter(F.split(module_name, r"\."), lambda x: x != "")
    if not compat:  # a package's own name is already its directory
        up = F.when(is_package, level - 1).otherwise(level)
        base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)).cast("int")), ".")
        whole = F.when(base == "", module).when(module == "", base).otherwise(F.concat(base, F.lit("."), module))
    else:
        base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)).cast("int")), ".")
        whole = F.when(F.size(parts) < level, module).when(base == "", F.lit(None)).when(module == "", base).otherwise(F.concat(base, F.lit("."), module))
    return F.when(kind == "Relative", whole).otherwise(module)


def import_edges(imports: DataFrame, files: DataFrame, compat: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """(src, dst) of imports that name a known module; self edges go, repeated ones stay; of one name the last file counts.

    `keep`: columns of the imports to hand on.
    """
    last = Window.partitionBy("module_name").orderBy(F.desc("file_id"))
    names = files.withColumn("__r", F.row_number().over(last)).filter("__r = 1").select(F.col("module_name").alias("target"), F.col("file_id").alias("dst"))
    me = files.select("file_id", "module_name", F.col("path").rlike(r"(^|/)__init__\.py$").alias("__pkg"))
    own = imports.join(me, "file_id").withColumn("target", target_module(F.col("module_name"), F.col("module"), F.col("kind"), F.coalesce("level", F.lit(0)), F.col("__pkg"), compat))
    return own.join(names, "target").filter("file_id <> dst").select(F.col("file_id").alias("src"), "dst", *keep)
