"""Queries that parse sources: one file for each part and language, and an analysis of a project of parts from end to end.

The sources are templates with the part's key and size filled in; the SQL fills the same values into the rows that the
rules of each language give for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..engine import Analysis
from ..functions import scalars as S
from ..operators import symbols as Y
from ..render import report
from ..sources import parsers
from .registry import query, read

#: language: (extension, source, rows of kind, name, detail, line) with {k} for the part's key and {s} for its size.
SOURCES = {
    "Python": (
        "py",
        '"""Part {k}."""\nimport os, sys as system\nfrom ..pkg.mod{k} import thing as other, more\nLIMIT: int = {s}\nlower = 1\n\n@dataclass\nclass Point{k}(Base, metaclass=Meta):\n    """A point."""\n    x: int = {s}\n\n    @property\n    def size(self) -> int:\n        return {s}\n\nasync def run{k}(a, /, b: str, *rest, c=1, **kw) -> None:\n    yield a\n',
        [
            ("doc", "", "Part {k}.", 0), ("import", "os", "Direct", 2), ("import", "sys", "Direct", 2), ("import", "pkg.mod{k}", "Relative", 3), ("constant", "LIMIT", "{s}", 4),
            ("class", "Point{k}", "Base", 7), ("attribute", "x", "int", 10), ("method", "size", "self", 12), ("function", "run{k}", "a,b,rest,c,kw", 16),
        ],
    ),
    "JavaScript": (
        "js",
        "import React, { useState as us } from 'react';\nimport './side{k}.css';\nconst { a, b: c } = require('./lib');\n/** Shop item. */\nexport class Item{k} extends Base {\n  count = {s};\n  async load(id, ...rest) { if (id) { go(); } }\n}\nexport async function fetch{k}(x = {s}) { return x; }\nconst add = (p, q) => p + q;\n",
        [
            ("import", "react", "From", 1), ("import", "./side{k}.css", "Relative", 2), ("import", "./lib", "Relative", 3), ("class", "Item{k}", "Base", 5), ("attribute", "count", "", 6),
            ("method", "load", "id,rest", 7), ("function", "fetch{k}", "x", 9), ("function", "add", "p,q", 10),
        ],
    ),
    "TypeScript": (
        "ts",
        "import * as path from 'path';\nexport class Store{k} {\n  private size: number = {s};\n  get(id: number): string { return ''; }\n}\nexport function open{k}(name: string, mode = 1): void { }\n",
        [("import", "path", "From", 1), ("class", "Store{k}", "", 2), ("attribute", "size", "number", 3), ("method", "get", "id", 4), ("function", "open{k}", "name,mode", 6)],
    ),
    "Rust": (
        "rs",
        "//! Crate {k}.\nuse std::collections::{HashMap, HashSet as S};\nuse crate::a{k}::B;\npub const MAX: usize = {s};\n/// A thing.\npub struct Thing{k} { pub name: String }\nenum Kind { A, B }\npub trait Run { fn run(&self); }\npub async fn main_loop{k}(n: u32) -> Result<(), E> { loop {} }\n",
        [
            ("doc", "", "Crate {k}.", 0), ("import", "std::collections", "From", 2), ("import", "crate::a{k}", "From", 3), ("constant", "MAX", "{s}", 4), ("class", "Thing{k}", "", 6),
            ("class", "Kind", "Enum", 7), ("class", "Run", "Trait", 8), ("method", "run", "&self", 8), ("function", "main_loop{k}", "n", 9),
        ],
    ),
    "Go": (
        "go",
        'package shop{k}\nimport (\n\t"fmt"\n\tj "encoding/json"\n)\nconst Limit = {s}\n// Item is sold.\ntype Item{k} struct {\n\tName string\n}\ntype Runner interface {\n\tRun(n int) error\n}\nfunc (i *Item{k}) Price(tax float64, rest ...int) float64 { return {s} }\nfunc New{k}() *Item{k} { return nil }\n',
        [
            ("doc", "", "package shop{k}", 0), ("import", "fmt", "Direct", 3), ("import", "encoding/json", "Direct", 4), ("constant", "Limit", "{s}", 6), ("class", "Item{k}", "", 8), ("attribute", "Name", "string", 9),
            ("class", "Runner", "Interface", 11), ("method", "Run", "n", 12), ("function", "Item{k}.Price", "tax,rest", 14), ("function", "New{k}", "", 15),
        ],
    ),
    "Java": (
        "java",
        "package com.shop{k};\nimport java.util.List;\nimport static java.lang.Math.*;\n/** Sells things. */\npublic class Shop{k} extends Base implements Open, Close {\n  private final int size = {s};\n  public Shop{k}(int size) { this.size = size; }\n  public List<String> names(String... more) { return null; }\n}\nenum Color { RED, GREEN }\nrecord Point(int x, int y) {}\n",
        [
            ("doc", "", "package com.shop{k}", 0), ("import", "java.util.List", "Direct", 2), ("import", "static java.lang.Math.*", "Direct", 3), ("class", "Shop{k}", "Base,Open,Close", 5), ("attribute", "size", "int", 6),
            ("method", "Shop{k}", "size", 7), ("method", "names", "more", 8), ("class", "Color", "Enum", 10), ("attribute", "RED", "Color", 10), ("attribute", "GREEN", "Color", 10), ("class", "Point", "Record", 11),
            ("attribute", "x", "int", 11), ("attribute", "y", "int", 11),
        ],
    ),
    "C": (
        "c",
        '#include <stdio.h>\n#include "a{k}.h"\nint counter{k} = {s};\nint add{k}(int a, int b);\n/* sums */\nint add{k}(int a, int b) {\n  return a + b;\n}\nstruct P { int x; };\nenum E { A, B };\n',
        [
            ("import", "stdio.h", "Direct", 1), ("import", "a{k}.h", "Direct", 2), ("constant", "counter{k}", "{s}", 3), ("function", "add{k}", "a,b", 4), ("function", "add{k}", "a,b", 6), ("class", "P", "struct", 9),
            ("attribute", "x", "int", 9), ("class", "E", "enum", 10), ("attribute", "A", "", 10), ("attribute", "B", "", 10),
        ],
    ),
    "Cpp": (
        "cpp",
        "#include <vector>\nusing std::vector;\nnamespace a { namespace b {\nclass Shape{k} : public Base {\npublic:\n  virtual double area() const = 0;\n  static Shape{k}* make(int n) { return 0; }\n};\ntemplate <typename T>\nT top{k}(T x) { return x; }\n}}\n",
        [
            ("import", "vector", "Direct", 1), ("import", "std", "From", 2), ("class", "a::b::Shape{k}", "Base", 4), ("method", "area", "", 6), ("method", "make", "n", 7), ("function", "a::b::top{k}", "x", 10),
        ],
    ),
}


def _filled(text):
    return F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))


def _spread(spark, parts):
    """A small file of parts makes many sources: else one task parses them all."""
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _files(spark, sf_dir, language):
    extension, text, _ = SOURCES[language]
    p = _spread(spark, read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    rel = F.concat(F.lit("src/part"), "p_partkey", F.lit(f".{extension}"))
    return p.select(rel.alias("path"), rel.alias("rel_path"), F.lit(language).alias("language"), _filled(F.lit(text)).alias("content"), F.lit(None).cast("string").alias("error"))


def _flat(parsed):
    """kind, name, detail and line of everything in parsed files."""
    names = lambda xs: F.array_join(F.transform(xs, lambda p: p["name"]), ",")
    row = lambda kind, name, detail, line: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.coalesce(detail, F.lit("")).alias("detail"), line.cast("long").alias("line"))
    none = F.lit("")
    doc = F.when(F.col("docstring").isNotNull(), F.array(row("doc", none, F.col("docstring"), F.lit(0)))).otherwise(F.array())
    function = lambda kind: lambda f: row(kind, f["name"], names(f["parameters"]), f["line_start"])
    parts = [
        doc, F.transform("imports", lambda i: row("import", i["module"], i["kind"], i["line"])), F.transform("constants", lambda c: row("constant", c["name"], c["value"], c["line"])),
        F.transform("classes", lambda c: row("class", c["name"], F.array_join(c["bases"], ","), c["line_start"])), F.transform("functions", function("function")),
        F.flatten(F.transform("classes", lambda c: F.transform(c["attributes"], lambda a: row("attribute", a["name"], a["type_hint"], a["line"])))),
        F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], function("method")))),
    ]
    return parsed.select("path", F.explode(F.concat(*parts)).alias("r")).select("path", "r.*")


def _sql(language):
    extension, _, rows = SOURCES[language]
    q = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{k}', '{q(n)}', '{q(d)}', {line}::BIGINT)" for k, n, d, line in rows)
    fill = lambda c: f"replace(replace({c}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"
    return f"SELECT 'src/part' || p_partkey || '.{extension}' AS path, kind, {fill('name')} AS name, {fill('detail')} AS detail, line FROM part, (VALUES {values}) v(kind, name, detail, line)"


def _register(language):
    @query(f"parse_{language.lower()}", _sql(language))
    def parse(spark, sf_dir):
        return _flat(parsers.parse_files(_files(spark, sf_dir, language)))


for _language in SOURCES:
    _register(_language)


@query("parse_errors", "SELECT 'src/part' || p_partkey || '.py' AS path, 'stream did not contain valid UTF-8' AS message FROM part WHERE p_size > 40")
def parse_errors(spark, sf_dir):
    bad = read(spark, sf_dir, "part").filter("p_size > 40").select(F.concat(F.lit("src/part"), "p_partkey", F.lit(".py")).alias("rel_path"))
    files = _files(spark, sf_dir, "Python").join(bad, "rel_path", "left_semi").withColumn("error", F.lit("stream did not contain valid UTF-8"))
    return Analysis(spark, files, parsers.parse_files(files.unionByName(_files(spark, sf_dir, "Python").join(bad, "rel_path", "left_anti"))), Config()).parse_errors


# a project: a package for each brand, a module for each part, which imports the part of the next key and extends its class
_P = """p AS (SELECT a.p_partkey AS k, a.p_size AS s, 'brand' || replace(a.p_brand, 'Brand#', '') AS b, n.p_partkey AS nk, 'brand' || replace(n.p_brand, 'Brand#', '') AS nb
  FROM part a LEFT JOIN part n ON n.p_partkey = a.p_partkey + 1),
f AS (SELECT *, b || '/m' || k || '.py' AS path, b || '.m' || k AS module_name, row_number() OVER (ORDER BY b, 'm' || k || '.py') - 1 AS file_id FROM p)"""


def project(spark, sf_dir) -> Analysis:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("brand"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("b"))
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("nk"), F.col("b").alias("nb"))
    p = _spread(spark, p)
    head = F.when(F.col("nk").isNull(), F.lit("import sys\n")).otherwise(F.concat(F.lit("from "), "nb", F.lit(".m"), "nk", F.lit(" import C"), "nk", F.lit("\n")))
    base = F.when(F.col("nk").isNull(), F.lit("")).otherwise(F.concat(F.lit("(C"), "nk", F.lit(")")))
    text = F.concat(
        _filled(F.lit('"""Module {k}."""\nimport os\n')), head, _filled(F.lit("LIMIT_{k} = {s}\n\nclass C{k}")), base,
        _filled(F.lit(':\n    """Class {k}."""\n    def get(self, x: int = {s}) -> int:\n        return x\n\nasync def run_{k}(a, *rest):\n    pass\n')))
    rel = F.concat("b", F.lit("/m"), "p_partkey", F.lit(".py"))
    files = p.join(n, "p_partkey", "left").select(rel.alias("path"), rel.alias("rel_path"), F.lit("Python").alias("language"), text.alias("content"), F.lit(None).cast("string").alias("error"))
    return Analysis(spark, files, parsers.parse_files(files), Config())


@query("project_files", f"WITH {_P} SELECT file_id, path, module_name, 'Module ' || k || '.' AS docstring, 12::BIGINT AS total_lines, 10::BIGINT AS code_lines, 0::BIGINT AS comment_lines FROM f")
def project_files(spark, sf_dir):
    return project(spark, sf_dir).files.drop("language")


@query("project_classes", f"WITH {_P} SELECT file_id AS class_id, file_id, 'C' || k AS name, CASE WHEN nk IS NULL THEN '' ELSE 'C' || nk END AS bases, 'Class ' || k || '.' AS docstring, 6::BIGINT AS line_start, 9::BIGINT AS line_end FROM f")
def project_classes(spark, sf_dir):
    return project(spark, sf_dir).classes.select("class_id", "file_id", "name", F.array_join("bases", ",").alias("bases"), "docstring", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query("project_functions", f"""WITH {_P} SELECT 2 * file_id AS function_id, file_id::VARCHAR AS class_id, 'get' AS name, 'def get(self, x: int = ' || s || ') -> int' AS signature FROM f
UNION ALL SELECT 2 * file_id + 1, NULL, 'run_' || k, 'async def run_' || k || '(a, *rest)' FROM f""")
def project_functions(spark, sf_dir):
    return project(spark, sf_dir).functions.select("function_id", F.col("class_id").cast("string").alias("class_id"), "name", "signature")


@query("project_constants", f"WITH {_P} SELECT file_id, 'LIMIT_' || k AS name, s::VARCHAR AS value, 4::BIGINT AS line FROM f")
def project_constants(spark, sf_dir):
    return project(spark, sf_dir).constants.select("file_id", "name", "value", F.col("line").cast("long").alias("line"))


@query("project_imports", f"""WITH {_P} SELECT file_id, 'os' AS module, 'Stdlib' AS import_type, NULL AS resolved_path FROM f
UNION ALL SELECT file_id, CASE WHEN nk IS NULL THEN 'sys' ELSE nb || '.m' || nk END, CASE WHEN nk IS NULL THEN 'Stdlib' ELSE 'Local' END, nb || '/m' || nk || '.py' FROM f""")
def project_imports(spark, sf_dir):
    return project(spark, sf_dir).resolved_imports.select("file_id", "module", "import_type", "resolved_path")


@query("project_structure", f"""WITH {_P} SELECT f.file_id AS src, n.file_id AS dst, 'Imports' AS kind FROM f JOIN f n ON n.k = f.nk
UNION ALL SELECT f.file_id, n.file_id, 'Inherits' FROM f JOIN f n ON n.k = f.nk UNION ALL SELECT file_id, file_id, 'DefinedIn' FROM f
UNION ALL SELECT 2 * file_id, file_id, 'DefinedIn' FROM f UNION ALL SELECT 2 * file_id + 1, file_id, 'DefinedIn' FROM f""")
def project_structure(spark, sf_dir):
    a = project(spark, sf_dir)
    return a.edges.select("src", "dst", "kind").unionByName(a.structure_edges.select("src", "dst", "kind"))


@query("project_symbols", f"""WITH {_P} SELECT path, 'C' || k AS name, 'class' AS kind FROM f UNION ALL SELECT path, 'get', 'method' FROM f UNION ALL SELECT path, 'run_' || k, 'function' FROM f""")
def project_symbols(spark, sf_dir):
    return project(spark, sf_dir).symbols.select("path", "name", F.lower("kind").alias("kind")).filter("kind <> 'module'")


@query("project_json", f"""WITH {_P} SELECT 'file' AS kind, file_id AS id, path AS name FROM f UNION ALL SELECT 'class', file_id, 'C' || k FROM f UNION ALL SELECT 'function', 2 * file_id, 'get' FROM f
UNION ALL SELECT 'function', 2 * file_id + 1, 'run_' || k FROM f UNION ALL SELECT 'edge', f.file_id, n.file_id::VARCHAR FROM f JOIN f n ON n.k = f.nk""")
def project_json(spark, sf_dir):
    g, get = report.graph_json(project(spark, sf_dir)), lambda *ks: F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in ks])
    edge = F.col("kind") == "edge"
    ident = F.when(edge, get("src")).when(F.col("kind") == "file", get("file_id")).when(F.col("kind") == "class", get("class_id")).otherwise(get("function_id"))
    return g.select("kind", ident.cast("long").alias("id"), F.when(edge, get("dst")).when(F.col("kind") == "file", get("path")).otherwise(get("name")).alias("name"))


@query("project_markdown", f"""WITH {_P} SELECT * FROM (SELECT '### ' || b AS line, 'module' AS part FROM f GROUP BY b UNION ALL SELECT '- **Files:** ' || count(*), 'module' FROM f GROUP BY b
UNION ALL SELECT '- **Type:** Generic', 'module' FROM f GROUP BY b UNION ALL SELECT '### C' || k, 'class' FROM f UNION ALL SELECT 'Inherits from: C' || nk, 'class' FROM f WHERE nk IS NOT NULL UNION ALL SELECT 'Class ' || k || '.', 'class' FROM f)""")
def project_markdown(spark, sf_dir):
    return report.markdown_rows(project(spark, sf_dir)).filter("line <> ''").select("line", "part")


@query("project_predicates", f"""WITH {_P} SELECT path, false AS is_empty, 'get' AS public_methods, '' AS special_methods, 'os' AS first_import, true AS inherits FROM f WHERE nk IS NOT NULL
UNION ALL SELECT path, false, 'get', '', 'os', false FROM f WHERE nk IS NULL""")
def project_predicates(spark, sf_dir):
    names = lambda xs: F.array_join(F.transform(xs, lambda m: m["name"]), ",")
    c = F.element_at("classes", 1)
    return project(spark, sf_dir).parsed.select(
        "path", S.is_empty("classes", "functions", "constants").alias("is_empty"), names(S.public_methods(c["methods"])).alias("public_methods"), names(S.special_methods(c["methods"])).alias("special_methods"),
        F.element_at("imports", 1)["module"].alias("first_import"), F.exists(c["bases"], lambda b: b.startswith("C")).alias("inherits"))


@query("imported_names", f"WITH {_P} SELECT path, CASE WHEN nk IS NULL THEN 'sys' ELSE 'C' || nk END AS used FROM f UNION ALL SELECT path, 'os' FROM f")
def imported_names(spark, sf_dir):
    n = project(spark, sf_dir).imports.select("path", F.explode("names").alias("n"))
    return n.select("path", S.used_name("n.alias", "n.name").alias("used"))


@query("method_flags", f"WITH {_P} SELECT 'get' AS name, true AS is_method, false AS is_test, count(*)::BIGINT AS n FROM f UNION ALL SELECT 'run', false, false, count(*) FROM f")
def method_flags(spark, sf_dir):
    f = project(spark, sf_dir).functions.select(F.element_at(F.split("name", "_"), 1).alias("name"), S.is_method("class_id").alias("is_method"), S.is_test("name", "decorators").alias("is_test"))
    return f.groupBy("name", "is_method", "is_test").agg(F.count("*").alias("n"))


@query("hover_module", f"""WITH {_P} SELECT path, '## Module: ' || module_name || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Language | Python |' || chr(10)
 || '| Dependencies | ' || CASE WHEN nk IS NULL THEN 0 ELSE 1 END || ' |' || chr(10) || '| Classes | 1 |' || chr(10) || '| Functions | 1 |' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Module ' || k || '.' AS text FROM f""")
def hover_module(spark, sf_dir):
    a = project(spark, sf_dir)
    count = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
    d = a.edges.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("dependencies"))
    m = a.files.join(d, "file_id", "left").join(count(a.classes, "n_classes"), "file_id", "left").join(count(a.functions.filter(~S.is_method("class_id")), "n_functions"), "file_id", "left").fillna(0, ["dependencies"])
    return m.select("path", Y.hover_module("module_name", "language", "dependencies", "n_classes", "n_functions", "docstring").alias("text"))


@query("project_summary", f"""WITH {_P} SELECT 'Analyzed ' || count(*) || ' files: ' || count(*) || ' classes, ' || 2 * count(*) || ' functions, ' || count(nk) || ' imports' AS line FROM f""")
def project_summary(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in report.console_summary(project(spark, sf_dir)).split("\n")], "line string")
