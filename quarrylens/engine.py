"""The engine: one analysis of a source tree as a set of DataFrames and temporary views."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import AnalysisError
from .functions import lines as L
from .functions import scalars as S
from .operators import cache as K
from .operators import diagnostics as G
from .operators import dynamic as D
from .operators import entities as E
from .operators import graph, metrics, modules, reach, resolve, symbols
from .session import cut
from .sources import parsers, scan


@dataclass
class Analysis:
    """Relations of one analysis. Each is built when first asked for, from the parsed files."""

    spark: SparkSession
    source: DataFrame  # files as read
    parsed: DataFrame
    config: Config
    compat: bool = False
    third_party: tuple[str, ...] = field(default=())

    @cached_property
    def _numbered(self) -> DataFrame:
        counts = self.source.select("path", L.counts("content", "language").alias("n"))
        named = self.parsed.withColumn("module_name", S.module_name("rel_path", "language"))
        rows = E.files(named).join(counts, "path")
        return cut(rows.select("*", F.col("n.total").alias("total_lines"), F.col("n.code").alias("code_lines"), F.col("n.comment").alias("comment_lines")).drop("n"))

    @cached_property
    def files(self) -> DataFrame:
        return self._numbered.select("file_id", F.col("rel_path").alias("path"), "module_name", "language", "docstring", "total_lines", "code_lines", "comment_lines")

    @cached_property
    def _classes(self) -> DataFrame:
        return cut(E.classes(self._numbered))

    @cached_property
    def classes(self) -> DataFrame:
        return self._classes.drop("methods", "attributes")

    @cached_property
    def functions(self) -> DataFrame:
        return cut(E.functions(self._numbered, self._classes))

    @cached_property
    def imports(self) -> DataFrame:
        return E.imports(self._numbered)

    @cached_property
    def constants(self) -> DataFrame:
        return E.constants(self._numbered)

    @cached_property
    def attributes(self) -> DataFrame:
        return E.attributes(self._classes)

    @cached_property
    def resolved_imports(self) -> DataFrame:
        return resolve.classify(self.imports, self.source.select(F.col("rel_path").alias("path")), third_party=self.third_party)

    @cached_property
    def edges(self) -> DataFrame:
        return cut(resolve.import_edges(self.imports.drop("path"), self.files, self.compat)).withColumn("kind", F.lit("Imports"))

    @cached_property
    def structure_edges(self) -> DataFrame:
        """DefinedIn (class or function to file) and Inherits (class to the class that its base names) edges."""
        d = self.classes.select(F.col("class_id").alias("src"), F.lit("class").alias("src_kind"), F.col("file_id").alias("dst"), F.lit("file").alias("dst_kind"), F.lit("DefinedIn").alias("kind"))
        f = self.functions.select(F.col("function_id").alias("src"), F.lit("function").alias("src_kind"), F.col("file_id").alias("dst"), F.lit("file").alias("dst_kind"), F.lit("DefinedIn").alias("kind"))
        inh = graph.inherits(self.classes, self.imports.drop("path"), self.files, self.compat)
        inh = inh.select("src", F.lit("class").alias("src_kind"), "dst", F.lit("class").alias("dst_kind"), F.lit("Inherits").alias("kind"))
        return d.unionByName(f).unionByName(inh)

    @cached_property
    def module_files(self) -> DataFrame:
        return modules.membership(self.files).select("module", "file_id", "path")

    @cached_property
    def modules(self) -> DataFrame:
        m = modules.detect(self.files)
        c = modules.coupling(self.module_files, self.imports.select("file_id", "module"))
        return m.join(c.drop("file_count"), "module", "left")

    @cached_property
    def file_metrics(self) -> DataFrame:
        return metrics.file_metrics(self.files, self.classes, self.functions, self.constants, self.resolved_imports)

    @cached_property
    def _totals(self) -> DataFrame:
        return self.file_metrics.withColumn("import_count", F.col("imports_total"))

    @cached_property
    def module_metrics(self) -> DataFrame:
        return metrics.module_metrics(self.module_files.select("module", "file_id"), self._totals)

    @cached_property
    def project_metrics(self) -> DataFrame:
        return metrics.project_metrics(self._totals)

    @cached_property
    def dynamic_findings(self) -> DataFrame:
        src = self.source.filter("language = 'Python' and error is null").select(F.col("rel_path").alias("path"), "content")
        return D.findings(src, ["path"], "content")

    @cached_property
    def dynamic_risk(self) -> DataFrame:
        return D.risk(self.dynamic_findings, ["path"], self.files.select("path"))

    @cached_property
    def parse_errors(self) -> DataFrame:
        return self.parsed.filter("error is not null").select(F.col("rel_path").alias("path"), F.col("error").alias("message"))

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols.build(self.files, self.classes, self.functions)

    @cached_property
    def search_index(self) -> DataFrame:
        return symbols.search_index(self.modules, self.files, self.classes, self.functions)

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges.select("src", "dst"))

    @cached_property
    def stats(self) -> DataFrame:
        return graph.stats(self.files, self.classes, self.functions, self.edges)

    def diagnostics(self, open_files: DataFrame) -> DataFrame:
        """Findings for open files (path)."""
        ring = self.cycles.select(F.array_join("cycle", "-").alias("cycle_id"), F.posexplode("cycle").alias("pos", "file_id"))
        ring = ring.join(self.files.select("file_id", "path"), "file_id").select("cycle_id", "pos", "path")
        return G.findings(self.files, self.classes, self.file_metrics, ring, open_files)

    def transitive_imports(self, paths: DataFrame, max_depth: int | None = None) -> DataFrame:
        start = self.files.join(paths.select("path"), "path", "left_semi")
        return reach.transitive_imports(self.edges.select("src", "dst"), start, max_depth or self.config.analysis.max_depth)

    VIEWS = (
        "files", "classes", "functions", "imports", "constants", "attributes", "resolved_imports", "edges", "modules", "module_files", "file_metrics", "module_metrics",
        "project_metrics", "dynamic_findings", "parse_errors", "symbols", "search_index",
    )

    def register_views(self, prefix: str = "") -> None:
        """All relations as temporary views, for free SQL."""
        for name in self.VIEWS:
            getattr(self, name).createOrReplaceTempView(prefix + name)
        S.register(self.spark)


class Engine:
    """Analyses source trees.

    With `cache`, a folder, parsed files are kept there: files with the same time or content are not parsed again.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, cache: str | None = None, compat: bool = False, third_party=()):
        self.spark, self.config, self.cache, self.compat, self.third_party = spark, config or Config(), cache, compat, tuple(third_party)

    def analyze(self, root: str) -> Analysis:
        found = scan.discover(self.spark, root, self.config.analysis.exclude)
        if found.select("path").isEmpty():
            raise AnalysisError("No source files found")
        source = scan.read(found)
        parsed = self._incremental(source, root) if self.cache else parsers.parse_files(source, self.compat)
        return Analysis(self.spark, source, cut(parsed), self.config, self.compat, self.third_party)

    def _incremental(self, source: DataFrame, root: str) -> DataFrame:
        key = K.config_hash(self.spark, {"analysis": vars(self.config.analysis), "compat": self.compat})
        old = K.load(self.spark, self.cache, key, root)
        if old is None:
            parsed = parsers.parse_files(source, self.compat)
        else:
            old = cut(K.prune(old, source))  # the folder is written again below
            hits, misses = K.split(source, old)
            parsed = old.join(hits.select("path"), "path", "left_semi").drop("mtime", "content_hash").unionByName(parsers.parse_files(misses, self.compat))
        parsed = cut(parsed)
        K.save(parsed.join(source.select("path", "mtime", "content_hash"), "path"), self.cache, key, root)
        return parsed
