"""Diagram text as rows: (part, key, line), to be joined in the order of part and key.

The line formats of Mermaid and DOT output are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph as G


def _line(part: int, key, text) -> list[Column]:
    return [F.lit(part).alias("part"), key.cast("string").alias("key") if isinstance(key, Column) else F.lit(key).alias("key"), text.alias("line")]


def _fixed(spark, part: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(part, f"{i:04d}", x) for i, x in enumerate(lines)], "part int, key string, line string")


def pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 20, "0")


def short_name(module: str | Column) -> Column:
    return F.element_at(F.split(S.col(module), r"\."), -1)


def dependency_graph(files: DataFrame, edges: DataFrame, direction: str = "TB") -> DataFrame:
    """Mermaid: a styled node for each file and an arrow for each distinct edge."""
    spark = files.sparkSession
    nodes = files.select(*_line(1, pad(F.col("file_id")), F.concat(F.lit("    "), S.sanitize_id("module_name"), F.lit("["), short_name("module_name"), F.lit("]"), S.node_style("module_name"))))
    e = G.labelled(edges.select("src", "dst").distinct(), files, "module_name")
    arrows = e.select(*_line(2, F.concat(pad(F.col("src")), pad(F.col("dst"))), F.concat(F.lit("    "), S.sanitize_id("src_module_name"), F.lit(" --> "), S.sanitize_id("dst_module_name"))))
    return _fixed(spark, 0, f"graph {direction}").unionByName(nodes).unionByName(arrows)


def module_level_graph(module_of: DataFrame, edges: DataFrame, direction: str = "TB") -> DataFrame:
    """Mermaid: modules with their file counts, arrows between different modules."""
    sizes = module_of.groupBy("module").agg(F.count("*").alias("n"))
    label = F.concat(F.lit("    "), S.sanitize_id("module"), F.lit('["'), "module", F.lit("\\n("), F.col("n").cast("string"), F.lit(' files)"]'))
    pairs = G.module_edges(edges, module_of)
    arrows = pairs.select(*_line(2, F.concat_ws("\t", "from_module", "to_module"), F.concat(F.lit("    "), S.sanitize_id("from_module"), F.lit(" --> "), S.sanitize_id("to_module"))))
    return _fixed(edges.sparkSession, 0, f"graph {direction}").unionByName(sizes.select(*_line(1, F.col("module"), label))).unionByName(arrows)


def adaptive_graph(files: DataFrame, module_of: DataFrame, edges: DataFrame, max_nodes: int = 100, direction: str = "TB") -> DataFrame:
    """The file graph, or the module graph where there are more than max_nodes files."""
    many = files.limit(max_nodes + 1).count() > max_nodes
    return module_level_graph(module_of, edges, direction) if many else dependency_graph(files, edges, direction)


def module_graph(module: str, files: DataFrame, module_of: DataFrame, edges: DataFrame, direction: str = "TB") -> DataFrame:
    """Mermaid: one module's files in a subgraph and its inner edges, repeated ones too."""
    own = files.join(module_of.filter(F.col("module") == module).select("file_id"), "file_id", "left_semi")
    name = F.element_at(F.split("path", "/"), -1)
    nodes = own.select(*_line(1, pad(F.col("file_id")), F.concat(F.lit("        "), S.sanitize_id("module_name"), F.lit("["), name, F.lit("]"))))
    inner = G.labelled(G.internal_edges(edges, module_of).filter(F.col("module") == module).select("src", "dst"), files, "module_name")
    arrows = inner.select(*_line(3, F.concat(pad(F.col("src")), pad(F.col("dst"))), F.concat(F.lit("    "), S.sanitize_id("src_module_name"), F.lit(" --> "), S.sanitize_id("dst_module_name"))))
    spark = files.sparkSession
    head = spark.range(1).select(*_line(0, "0000", F.lit(f"graph {direction}"))).unionByName(
        spark.range(1).select(*_line(0, "0001", F.concat(F.lit("    subgraph "), S.sanitize_id(F.lit(module)), F.lit(f" [{module}]")))))
    return head.unionByName(nodes).unionByName(_fixed(spark, 2, "    end")).unionByName(arrows)


def class_hierarchy(classes: DataFrame, methods: DataFrame, direction: str = "TB", most: int = 5) -> DataFrame:
    """Mermaid class diagram. classes: class_id, name, bases; methods: class_id, ordinal, name."""
    m = methods.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("ms"))
    c = classes.join(m, "class_id", "left").withColumn("ms", F.coalesce("ms", F.array().cast("array<struct<ordinal:int,name:string>>")))
    safe = S.sanitize_class_name("name")
    shown = F.transform(F.slice("ms", 1, most), lambda x: F.concat(F.lit("        "), F.when(x["name"].startswith("_"), "-").otherwise("+"), x["name"], F.lit("()")))
    more = F.when(F.size("ms") > most, F.array(F.concat(F.lit("        +... "), (F.size("ms") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    bases = F.transform("bases", lambda b: F.concat(F.lit("    "), S.sanitize_class_name(b), F.lit(" <|-- "), safe))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("    class "), safe, F.lit(" {"))), shown, more, F.array(F.lit("    }")), bases), "\n")
    return _fixed(classes.sparkSession, 0, "classDiagram", f"    direction {direction}").unionByName(c.select(*_line(1, pad(F.col("class_id")), block)))


def dot(files: DataFrame, module_of: DataFrame, edges: DataFrame, direction: str = "TB", cluster: bool = False) -> DataFrame:
    """Graphviz text; with cluster, one subgraph for each module."""
    spark = files.sparkSession
    f = files.join(module_of, "file_id", "left")
    color = S.node_color(F.coalesce("module", F.lit("")))
    node = F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit(' [label="'), short_name("module_name"), F.lit('", fillcolor="'), color, F.lit('"];'))
    if cluster:
        inside = f.select(F.coalesce("module", F.lit("root")).alias("m"), "file_id", F.concat(F.lit("        "), node).alias("n"))
        body = F.transform(F.sort_array(F.collect_list(F.struct("file_id", "n"))), lambda x: x["n"])
        opening = F.array(F.concat(F.lit("    subgraph cluster_"), S.sanitize_path_id("m"), F.lit(" {")), F.concat(F.lit('        label="'), F.col("m"), F.lit('";')), F.lit("        style=filled;"), F.lit("        color=lightgrey;"))
        groups = inside.groupBy("m").agg(body.alias("b"))
        nodes = groups.select(*_line(1, F.col("m"), F.array_join(F.concat(opening, F.col("b"), F.array(F.lit("    }"))), "\n")))
    else:
        nodes = f.select(*_line(1, pad(F.col("file_id")), F.concat(F.lit("    "), node)))
    e = edges.select("src", "dst").distinct().join(files.select(F.col("file_id").alias("src")), "src", "left_semi").join(files.select(F.col("file_id").alias("dst")), "dst", "left_semi")
    arrows = e.select(*_line(3, F.concat(pad(F.col("src")), pad(F.col("dst"))), F.concat(F.lit("    f"), F.col("src").cast("string"), F.lit(" -> f"), F.col("dst").cast("string"), F.lit(";"))))
    head = _fixed(spark, 0, "digraph dependencies {", f"    rankdir={direction};", '    node [shape=box, style=filled, fontname="Helvetica"];', '    edge [color="#666666"];', "")
    return head.unionByName(nodes).unionByName(_fixed(spark, 2, "")).unionByName(arrows).unionByName(_fixed(spark, 4, "}"))


def mermaid(files: DataFrame, module_of: DataFrame, edges: DataFrame, direction: str = "TB", cluster: bool = False) -> DataFrame:
    """Mermaid export: ids keep all but `.`, `/`, `-` and blanks."""
    spark = files.sparkSession
    f = files.join(module_of, "file_id", "left")
    node = F.concat(S.sanitize_path_id("module_name"), F.lit("["), short_name("module_name"), F.lit("]"))
    if cluster:
        inside = f.select(F.coalesce("module", F.lit("root")).alias("m"), "file_id", F.concat(F.lit("        "), node).alias("n"))
        body = F.transform(F.sort_array(F.collect_list(F.struct("file_id", "n"))), lambda x: x["n"])
        opening = F.array(F.concat(F.lit("    subgraph "), S.sanitize_path_id("m"), F.lit("["), F.col("m"), F.lit("]")))
        nodes = inside.groupBy("m").agg(body.alias("b")).select(*_line(1, F.col("m"), F.array_join(F.concat(opening, F.col("b"), F.array(F.lit("    end"))), "\n")))
    else:
        nodes = f.select(*_line(1, pad(F.col("file_id")), F.concat(F.lit("    "), node)))
    e = G.labelled(edges.select("src", "dst").distinct(), files, "module_name")
    arrows = e.select(*_line(2, F.concat(pad(F.col("src")), pad(F.col("dst"))), F.concat(F.lit("    "), S.sanitize_path_id("src_module_name"), F.lit(" --> "), S.sanitize_path_id("dst_module_name"))))
    return _fixed(spark, 0, f"graph {direction}").unionByName(nodes).unionByName(arrows)


def text(lines: DataFrame) -> str:
    """The diagram as one string, on the driver: for files of a report."""
    return "\n".join(r.line for r in lines.orderBy("part", "key").toLocalIterator())
