"""Engine on small source trees made here."""

from __future__ import annotations

import json
import os

import pytest

from quarrylens import cli
from quarrylens.config import Config
from quarrylens.engine import Engine
from quarrylens.errors import AnalysisError, ConfigError, ExportError
from quarrylens.operators import diagrams as D
from quarrylens.operators import symbols as Y
from quarrylens.render import explain, export, report
from quarrylens.sources import scan

TREE = {
    "__init__.py": '"""Top."""\n',
    "app.py": '"""App."""\nimport os\nimport numpy\nfrom models.item import Item\nfrom . import tools\n\nMAX = 3\n\ndef run(n: int = 1) -> int:\n    """Runs."""\n    return eval("n")\n\ndef _hidden():\n    pass\n',
    "tools.py": "def helper():\n    return 1\n",
    "models/__init__.py": "from .item import Item\n",
    "models/item.py": "from ..tools import helper\nfrom dataclasses import dataclass\n\n@dataclass\nclass Item(Base):\n    name: str = ''\n\n    def price(self):\n        return getattr(self, 'x')\n\n    def _secret(self):\n        pass\n\nclass Plain(Item):\n    pass\n",
    "web/main.js": "import x from './lib';\n// c\nexport function go() {}\n",
    "bad.py": b"\xff\xfe\x00",
    "notes.txt": "no source",
    "tests/test_app.py": "def test_x(): pass\n",
}


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    write(r, TREE)
    return r


@pytest.fixture(scope="module")
def analysis(spark, root):
    return Engine(spark).analyze(str(root))


def test_discovery(spark, root):
    found = scan.by_path(scan.discover(spark, str(root))).collect()
    assert [r.rel_path for r in found] == ["__init__.py", "app.py", "bad.py", "models/__init__.py", "models/item.py", "tools.py", "web/main.js"]
    assert {r.language: r.files for r in scan.file_counts(scan.discover(spark, str(root))).collect()} == {"Python": 6, "JavaScript": 1}
    with pytest.raises(AnalysisError):
        scan.discover(spark, str(root / "nowhere"))


def test_empty_tree(spark, tmp_path):
    with pytest.raises(AnalysisError, match="No source files"):
        Engine(spark).analyze(str(tmp_path))


def test_relations(analysis):
    files = {r.path: r for r in analysis.files.collect()}
    assert [files[p].file_id for p in sorted(files, key=lambda p: p.split("/"))] == list(range(6))
    assert files["models/__init__.py"].module_name == "models" and files["web/main.js"].module_name == "web/main" and files["app.py"].docstring == "App."
    assert [(r.path, "UTF-8" in r.message) for r in analysis.parse_errors.collect()] == [("bad.py", True)]
    fns = analysis.functions.orderBy("function_id").collect()
    assert [f.name for f in fns] == ["run", "_hidden", "price", "_secret", "helper", "go"] and fns[0].signature == "def run(n: int = 1) -> int"
    names = {r.file_id: r.path for r in files.values()}
    edges = {(names[e.src], names[e.dst]) for e in analysis.edges.collect()}
    assert edges == {("app.py", "models/item.py"), ("models/__init__.py", "models/item.py"), ("models/item.py", "tools.py"), ("app.py", "__init__.py")}
    kinds = {(r.path, r.module): r.import_type for r in analysis.resolved_imports.collect()}
    assert kinds[("app.py", "os")] == "Stdlib" and kinds[("app.py", "numpy")] == "ThirdParty" and kinds[("app.py", "models.item")] == "Local" and kinds[("models/item.py", "tools")] == "Local"
    assert {r.kind for r in analysis.structure_edges.collect()} == {"DefinedIn", "Inherits"}


def test_compat_keeps_known_losses(spark, root):
    a = Engine(spark, compat=True).analyze(str(root))
    assert [r.name for r in a.classes.collect()] == ["Plain"]
    names = {r.file_id: r.path for r in a.files.collect()}
    assert {(names[e.src], names[e.dst]) for e in a.edges.collect()} == {("app.py", "models/item.py")}


def test_metrics_and_modules(analysis):
    by = {r.path: r for r in analysis.file_metrics.join(analysis.files.select("file_id", "path"), "file_id").collect()}
    m = by["models/item.py"]
    assert (m.class_count, m.method_count, m.function_count, m.complexity, m.public_ratio, m.max_function_length, m.imports_local) == (2, 2, 2, 4, 0.5, 2, 1)
    assert by["models/__init__.py"].public_ratio == 1.0 and by["app.py"].constant_count == 1 and by["app.py"].imports_total == 4
    p = analysis.project_metrics.first()
    assert (p.file_count, p.class_count, p.function_count) == (6, 2, 6)
    mods = {r.module: r for r in analysis.modules.collect()}
    assert set(mods) == {"root", "models", "web"} and mods["models"].is_package and mods["models"].module_type == "Models" and mods["models"].incoming_imports == 1
    assert {r.module: r.avg_function_count for r in analysis.module_metrics.collect()}["root"] == 1
    assert {r.path: r.risk for r in analysis.dynamic_risk.collect()} == {"__init__.py": 0, "app.py": 25, "tools.py": 0, "models/__init__.py": 0, "models/item.py": 10, "web/main.js": 0}


def test_symbols_and_search(spark, analysis):
    s = analysis.symbols
    probe = spark.createDataFrame([(1, "models/item.py", 7), (2, "models/item.py", 5), (3, "models/item.py", 0), (4, "app.py", 9)], "id int, path string, line int")
    got = {r.id: (r.kind, r.name) for r in Y.at_position(probe, s, "id").collect()}
    assert got == {1: ("method", "price"), 2: ("class", "Item"), 3: ("module", None), 4: ("function", "run")}
    assert {r.name for r in Y.workspace_symbols(s, "IT").collect()} == {"Item"}
    assert Y.site_search(analysis.search_index, " ").count() == 0 and Y.site_search(analysis.search_index, "runs").first().name == "run"
    outline = {r.name: r.children for r in Y.document_symbols(s).filter("path = 'models/item.py'").collect()}
    assert [c.name for c in outline["Item"]] == ["price", "_secret"] and outline["Plain"] is None


def test_views_and_sql(spark, analysis):
    analysis.register_views("t_")
    assert spark.sql("SELECT count(*) n FROM t_functions f JOIN t_files USING (file_id) WHERE path = 'app.py'").first().n == 2


def test_cycles_and_diagnostics(spark, tmp_path):
    write(tmp_path, {"a.py": "import b\n", "b.py": "import c\n", "c.py": "import a\n", "d.py": "import a\n"})
    a = Engine(spark).analyze(str(tmp_path))
    assert [r.cycle for r in a.cycles.collect()] == [[0, 1, 2]]
    open_files = spark.createDataFrame([("a.py",), ("d.py",), ("gone.py",)], "path string")
    got = {(r.path, r.code): r for r in a.diagnostics(open_files).collect()}
    assert set(got) == {("a.py", "circular-dependency"), ("a.py", "missing-module-docs"), ("d.py", "missing-module-docs"), ("gone.py", None)}
    r = got[("a.py", "circular-dependency")]
    assert r.message == "Circular dependency detected: a.py -> b.py -> c.py" and r.related == ["b.py", "c.py"] and r.severity == "ERROR"
    reach = a.transitive_imports(spark.createDataFrame([("d.py",)], "path string"), 2).collect()
    assert {(r.file_id, r.depth) for r in reach} == {(0, 1), (1, 2)}


def test_incremental(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    write(src, {"a.py": "X = 1\n", "b.py": "def f(): pass\n"})
    e = Engine(spark, cache=cache)
    assert e.analyze(str(src)).functions.count() == 1
    os.remove(src / "a.py")
    write(src, {"b.py": "def f(): pass\ndef g(): pass\n", "c.py": "class C: pass\n"})
    os.utime(src / "b.py", (1, 1))
    a = e.analyze(str(src))
    assert a.functions.count() == 2 and a.classes.count() == 1 and a.files.count() == 2
    assert spark.read.parquet(cache).count() == 2


def test_reports(analysis, tmp_path):
    text = report.markdown(analysis, "Demo")
    assert text.startswith("# Demo\n") and "- **Files:** 6" in text and "Inherits from: Base" in text
    report.write_json(analysis, str(tmp_path / "analysis.json"))
    data = json.loads((tmp_path / "analysis.json").read_text())
    assert len(data["files"]) == 6 and len(data["edges"]) == 4
    pages = report.write_site(analysis, str(tmp_path / "site"))
    assert pages == 1 + 3 + 2 and (tmp_path / "site/modules/models/item.html").exists() and (tmp_path / "site/index.html").exists()
    index = json.loads((tmp_path / "site/search.json").read_text())
    assert [e["kind"] for e in index] == ["module"] * 3 + ["file"] * 6 + ["class"] * 2 + ["function"] * 4
    mmd = (tmp_path / "site/assets/diagrams/dependency.mmd").read_text()
    assert mmd.startswith("graph TB\n") and "app --> models_item" in mmd
    assert "Item <|-- Plain" in (tmp_path / "site/assets/diagrams/classes.mmd").read_text()
    assert "bad.py" in report.console_summary(analysis)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/page.html").write_text("<own>$title</own>")
    report.write_site(analysis, str(tmp_path / "own"), str(tmp_path / "t"))
    assert (tmp_path / "own/modules/models/item.html").read_text() == "<own>Item</own>"


def test_export(analysis):
    dot = export.text(analysis, export.Options("DOT", cluster=True))
    assert dot.startswith("digraph dependencies {") and "subgraph cluster_models" in dot and dot.endswith("}")
    only = export.text(analysis, export.Options("mmd", modules=("models",)))
    assert "models_item" in only and "tools" not in only
    with pytest.raises(ExportError):
        export.text(analysis, export.Options("bmp"))
    try:
        assert export.export(analysis, export.Options("svg"))
    except ExportError as e:
        assert "graphviz" in str(e)
    assert D.text(D.adaptive_graph(analysis.files, analysis.module_files.select("file_id", "module"), analysis.edges.select("src", "dst"), max_nodes=2)).count("files)") == 3


def test_explanations(analysis):
    asked = explain.requests(analysis)
    plain = {(r.kind, r.id): r.text for r in explain.explain(asked).collect()}
    assert plain[("class", 0)] == "The Item class has 2 methods. It inherits from Base."
    assert plain[("function", 0)] == "The run is an function that takes 1 parameter. Returns int."

    def provider(prompt):
        if "Function: run" in prompt:
            return "It runs."
        raise OSError("no network")

    told = {(r.kind, r.id): r.text for r in explain.explain(asked, provider).collect()}
    assert told[("function", 0)] == "It runs." and told[("class", 0)] == plain[("class", 0)]


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[project]\nname = "X"\n[analysis]\nmax_depth = 7\nexclude = ["gen/**"]\n[output]\nformat = "json"\n')
    c = Config.load(str(p)).merge_cli(exclude=["y"], depth=9, no_diagrams=True, format="md")
    assert (c.project.name, c.analysis.max_depth, c.analysis.exclude, c.output.format, c.diagrams.enabled) == ("X", 9, ["gen/**", "y"], "markdown", False)
    p.write_text("[analysis]\nmax_depth = 101\n")
    with pytest.raises(ConfigError):
        Config.load(str(p))
    assert Config.load_or_default(str(p)).analysis.max_depth == 5
    assert scan.find_workspace_root(str(tmp_path)) == str(tmp_path)


def test_command_line(spark, root, tmp_path, capsys):
    assert cli.main(["analyze", str(root), "-o", str(tmp_path / "o"), "-f", "markdown", "-c", "none.toml", "-v"]) == 0
    assert (tmp_path / "o/README.md").exists() and "Python: 6 files" in capsys.readouterr().out
    assert cli.main(["export", str(root), "-f", "dot", "-o", str(tmp_path / "g.dot")]) == 0 and (tmp_path / "g.dot").read_text().startswith("digraph")
    assert cli.main(["analyze", str(root / "none")]) == 1
    assert cli.main(["version"]) == 0


def test_numbers_are_dense_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from quarrylens.operators.entities import number

    df = spark.range(0, 60_000, 1, 16).select((F.col("id") * 7919 % 60_013).alias("k"))
    assert number(df, "n", F.col("k")).select(F.count("*"), F.max("n"), F.countDistinct("n")).first()[:] == (60_000, 59_999, 60_000)
    rank = {r.k: r.n for r in number(df, "n", F.col("k")).collect()}
    assert [rank[k] for k in sorted(rank)] == list(range(60_000))


def test_summary_parses_each_file_once(spark):
    """Parsed files that are not kept anywhere: the summary evaluates each row a single time."""
    from quarrylens.config import Config
    from quarrylens.engine import Analysis
    from quarrylens.sources import parsers

    seen = spark.sparkContext.accumulator(0)
    rows = [(f"p/m{i}.py", f"p/m{i}.py", "Python", f"import p.m{i + 1}\nclass A:\n    def f(self): pass\ndef g(): pass\n", None if i else "unreadable") for i in range(20)]
    source = spark.createDataFrame(rows, "path string, rel_path string, language string, content string, error string")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    parsed = parsers.parse_files(source).mapInArrow(count, parsers.PARSED)
    text = report.console_summary(Analysis(spark, source, parsed, Config())).split("\n")
    assert text[0] == "Analyzed 19 files: 19 classes, 38 functions, 18 imports" and len(text) == 2 and text[1] == "  p/m0.py: unreadable"
    assert seen.value == 20
