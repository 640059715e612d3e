"""Queries of metrics, modules, import resolution, symbols, diagnostics, cache and open-file state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lines as L
from ..functions import names as N
from ..functions import scalars as S
from ..operators import cache as K
from ..operators import diagnostics as G
from ..operators import metrics as M
from ..operators import modules as O
from ..operators import resolve as R
from ..operators import search as X
from ..operators import symbols as Y
from ..session import shared_folder
from ..streaming import state as T
from .graph_queries import EDGES_SQL, edges
from .registry import query, read
from .text_queries import _LINES_SQL, _TRIM, PATHS_SQL, _case, paths

_COUNTS = f"""counts AS (SELECT doc_id AS file_id, len(ls)::BIGINT AS total_lines, len(list_filter(ts, lambda x: x <> '' AND NOT starts_with(x, '#')))::BIGINT AS code_lines, len(list_filter(ts, lambda x: contains(x, '#')))::BIGINT AS comment_lines
FROM (SELECT doc_id, ls, list_transform(ls, lambda x: {_TRIM}) AS ts FROM {_LINES_SQL.format(src="text")})),
fm AS (SELECT c.*, source AS module, (doc_id % 3)::BIGINT AS class_count, (doc_id % 5)::BIGINT AS function_count, (doc_id % 4)::BIGINT AS import_count, (doc_id % 3 + doc_id % 5)::BIGINT AS complexity, (doc_id % 7 + 1)::DOUBLE AS avg_function_length
  FROM counts c JOIN documents ON doc_id = file_id)"""


def doc_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", L.hash_comment_counts("text").alias("c"))
    i = F.col("doc_id")
    return d.select(
        i.alias("file_id"), F.col("source").alias("module"), F.col("c.total").alias("total_lines"), F.col("c.code").alias("code_lines"), F.col("c.comment").alias("comment_lines"),
        (i % 3).alias("class_count"), (i % 5).alias("function_count"), (i % 4).alias("import_count"), (i % 3 + i % 5).alias("complexity"), (i % 7 + 1).cast("double").alias("avg_function_length"))


@query("module_metrics", f"WITH {_COUNTS} SELECT module, count(*)::BIGINT AS file_count, " + ", ".join(f"sum({c})::BIGINT AS {c}, (sum({c}) // count(*))::BIGINT AS avg_{c}" for c in M.TOTALS) + " FROM fm GROUP BY module")
def module_metrics(spark, sf_dir):
    m = doc_metrics(spark, sf_dir)
    return M.module_metrics(m.select("module", "file_id"), m.drop("module"))


@query("project_metrics", f"""WITH {_COUNTS} SELECT count(*)::BIGINT AS file_count, {", ".join(f"sum({c})::BIGINT AS " + (c if c != "complexity" else "total_complexity") for c in M.TOTALS)}, max(total_lines)::BIGINT AS max_file_size,
 round(avg(total_lines), 6) AS avg_file_size, round(avg(CASE WHEN function_count > 0 THEN avg_function_length END), 6) AS avg_function_length, round(sum(comment_lines) / sum(code_lines), 6) AS comment_ratio FROM fm""")
def project_metrics(spark, sf_dir):
    p = M.project_metrics(doc_metrics(spark, sf_dir).drop("module"))
    return p.withColumns({c: F.round(c, 6) for c in ("avg_file_size", "avg_function_length", "comment_ratio")})


@query("file_metrics", """WITH li AS (SELECT *, l_returnflag = 'R' AS private, l_linenumber % 2 = 0 AS method, l_quantity::BIGINT + 1 AS len FROM lineitem),
f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (method) AS m, avg(len) AS a, max(len) AS x, count(*) FILTER (NOT private) AS p FROM li GROUP BY 1)
SELECT o_orderkey AS file_id, 100::BIGINT AS total_lines, 60::BIGINT AS code_lines, (o_orderkey % 50)::BIGINT AS comment_lines, greatest(40 - o_orderkey % 50, 0)::BIGINT AS blank_lines, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS class_count,
 coalesce(n, 0)::BIGINT AS function_count, coalesce(n - m, 0)::BIGINT AS top_level_function_count, coalesce(m, 0)::BIGINT AS method_count, 0::BIGINT AS constant_count, 0::BIGINT AS imports_total, 0::BIGINT AS imports_stdlib, 0::BIGINT AS imports_third_party, 0::BIGINT AS imports_local, 0::BIGINT AS imports_unknown,
 round(coalesce(a, 0), 6) AS avg_function_length, coalesce(x, 0)::BIGINT AS max_function_length, round(coalesce(p / n, 1.0), 6) AS public_ratio, (coalesce(n, 0) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS complexity
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def file_metrics(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    f = o.select(F.col("o_orderkey").alias("file_id"), F.lit(100).cast("long").alias("total_lines"), F.lit(60).cast("long").alias("code_lines"), (F.col("o_orderkey") % 50).alias("comment_lines"))
    c = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"))
    fn = li.select(
        F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("class_id"), F.when(F.col("l_returnflag") == "R", "_x").otherwise("x").alias("name"),
        F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("line_end"))
    return M.file_metrics(f, c, fn).withColumns({"avg_function_length": F.round("avg_function_length", 6), "public_ratio": F.round("public_ratio", 6)})


@query("module_page_stats", "SELECT source AS module, count(*)::BIGINT AS files, sum(doc_id % 3)::BIGINT AS classes, sum(doc_id % 5)::BIGINT AS functions FROM documents GROUP BY 1")
def module_page_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("module"))
    times = lambda k: d.filter(F.col("file_id") % k > 0).select("file_id", F.explode(F.sequence(F.lit(1), F.col("file_id") % k)).alias("i"))
    return M.module_page_stats(d.select("module", "file_id"), times(3), times(5))


# imports: each page imports the page of the next number by its path, a standard module, a third-party one, or something relative
_IMPORTS = f"""{PATHS_SQL}, f AS (SELECT page_id AS file_id, replace(base, '.', '_') || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path, replace(base, '.', '_') AS base FROM paths),
i AS (SELECT f.file_id, f.path, CASE WHEN f.file_id % 5 = 0 THEN 'os.path' WHEN f.file_id % 5 = 1 THEN 'numpy.linalg' WHEN f.file_id % 5 = 2 THEN string_split(CASE WHEN f.file_id % 3 = 0 THEN f.base ELSE n.base END, '/')[-1] ELSE replace(n.base, '/', '.') END AS module,
  CASE WHEN f.file_id % 5 = 2 THEN 'Relative' ELSE 'From' END AS kind, 1 + f.file_id % 2 AS level FROM f JOIN f n ON n.file_id = f.file_id + 1)"""


def page_files(spark, sf_dir, base="base"):
    p = paths(spark, sf_dir).select("page_id", F.expr(base).alias("base"))
    return p.select(F.col("page_id").alias("file_id"), F.concat("base", F.when(F.col("page_id") % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"), "base")


def importable_files(spark, sf_dir):
    """The same under names without dots, which an import can spell."""
    return page_files(spark, sf_dir, "replace(base, '.', '_')")


def page_imports(spark, sf_dir):
    f = importable_files(spark, sf_dir)
    nx = f.select((F.col("file_id") - 1).alias("file_id"), F.col("base").alias("next"))
    k = F.col("file_id") % 5
    leaf = F.element_at(F.split(F.when(F.col("file_id") % 3 == 0, F.col("base")).otherwise(F.col("next")), "/"), -1)
    module = F.when(k == 0, "os.path").when(k == 1, "numpy.linalg").when(k == 2, leaf).otherwise(F.replace("next", F.lit("/"), F.lit(".")))
    return f.join(nx, "file_id").select(
        "file_id", "path", module.alias("module"), F.when(k == 2, "Relative").otherwise("From").alias("kind"), (1 + F.col("file_id") % 2).cast("int").alias("level"))


_CLASSIFIED = _IMPORTS + f""",
p AS (SELECT *, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS parts, replace(module, '.', '/') AS mp FROM i),
q AS (SELECT *, CASE WHEN kind = 'Relative' THEN CASE WHEN array_to_string(list_slice(parts, 1, len(parts) - (level - 1)), '/') = '' THEN mp ELSE array_to_string(list_slice(parts, 1, len(parts) - (level - 1)), '/') || '/' || mp END ELSE mp END AS tp FROM p),
h AS (SELECT q.*, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.path = tp || '.py') THEN tp || '.py' WHEN EXISTS (SELECT 1 FROM f WHERE f.path = tp || '/__init__.py') THEN tp || '/__init__.py' END AS found FROM q),
res AS (SELECT file_id, module, found, tp, kind, CASE WHEN kind = 'Relative' THEN CASE WHEN found IS NULL THEN 'Unknown' ELSE 'Local' END WHEN string_split(module, '.')[1] IN ('os') THEN 'Stdlib' WHEN found IS NOT NULL THEN 'Local' ELSE 'ThirdParty' END AS import_type FROM h)"""


@query("import_resolution", f"WITH {_CLASSIFIED} SELECT file_id, module, import_type, CASE WHEN import_type = 'Local' THEN replace(tp, '/', '.') WHEN kind = 'Relative' THEN NULL ELSE module END AS resolved_module, CASE WHEN import_type = 'Local' THEN found END AS resolved_path FROM res")
def import_resolution(spark, sf_dir):
    r = R.classify(page_imports(spark, sf_dir), importable_files(spark, sf_dir))
    return r.select("file_id", "module", "import_type", "resolved_module", "resolved_path")


@query("local_imports", f"WITH {_CLASSIFIED} SELECT file_id, module FROM res WHERE import_type = 'Local'")
def local_imports(spark, sf_dir):
    return R.classify(page_imports(spark, sf_dir), importable_files(spark, sf_dir)).filter("import_type = 'Local'").select("file_id", "module")


@query("import_metrics", f"WITH {_CLASSIFIED} SELECT file_id, count(*)::BIGINT AS imports_total, (count(*) FILTER (import_type = 'Stdlib'))::BIGINT AS imports_stdlib, (count(*) FILTER (import_type = 'ThirdParty'))::BIGINT AS imports_third_party, (count(*) FILTER (import_type = 'Local'))::BIGINT AS imports_local, (count(*) FILTER (import_type = 'Unknown'))::BIGINT AS imports_unknown FROM res GROUP BY file_id")
def import_metrics(spark, sf_dir):
    return M.import_metrics(R.classify(page_imports(spark, sf_dir), importable_files(spark, sf_dir)))


@query("import_edges", "SELECT a.l_partkey AS src, b.p_partkey AS dst FROM lineitem a JOIN part b ON b.p_partkey = a.l_suppkey WHERE a.l_partkey <> b.p_partkey AND b.p_partkey = (SELECT max(p_partkey) FROM part c WHERE c.p_partkey = b.p_partkey)")
def import_edges(spark, sf_dir):
    f = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("pkg.m"), "p_partkey").alias("module_name"), F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("path"))
    i = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("file_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), "l_suppkey")).otherwise(F.concat(F.lit("pkg.m"), "l_suppkey")).alias("module"),
        F.when(F.col("l_linenumber") % 2 == 0, "Relative").otherwise("From").alias("kind"), F.lit(1).alias("level"))
    return R.import_edges(i, f)


_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_MODULES = f"""{PATHS_SQL}, f AS (SELECT page_id AS file_id, base || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM paths),
m AS (SELECT CASE WHEN {_DIR} = '' THEN 'root' ELSE replace({_DIR}, '/', '.') END AS module, {_DIR} AS path, count(*)::BIGINT AS file_count, bool_or(ends_with(path, '/__init__.py')) AS is_package FROM f GROUP BY 1, 2),
t AS (SELECT *, {_case("lower(string_split(path, '/')[-1])", N.MODULE_TYPES, "Generic")} AS module_type FROM m)"""


@query("module_detect", f"WITH {_MODULES} SELECT * FROM t WHERE file_count >= 2")
def module_detect(spark, sf_dir):
    return O.detect(page_files(spark, sf_dir), min_files=2)


@query("module_stats", f"WITH {_MODULES} SELECT count(*)::BIGINT AS total, (count(*) FILTER (is_package))::BIGINT AS packages, round(avg(file_count), 6) AS avg_files, 0 AS max_coupling, (SELECT string_agg(module_type || '=' || n, ',' ORDER BY module_type) FROM (SELECT module_type, count(*) AS n FROM t GROUP BY 1)) AS by_type FROM t")
def module_stats(spark, sf_dir):
    s = O.stats(O.detect(page_files(spark, sf_dir)))
    text = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("total", "packages", F.round("avg_files", 6).alias("avg_files"), "max_coupling", text.alias("by_type"))


@query("module_lookup", f"WITH {_MODULES} SELECT module, 'root' AS found_by FROM t WHERE NOT contains(module, '.') AND module <> 'root' UNION ALL SELECT module, 'type' FROM t WHERE module_type = 'Generic'")
def module_lookup(spark, sf_dir):
    m = O.detect(page_files(spark, sf_dir))
    return O.find_root_modules(m).select("module", F.lit("root").alias("found_by")).unionByName(O.find_by_type(m, "Generic").select("module", F.lit("type").alias("found_by")))


@query("coupling", f"""WITH {EDGES_SQL}, pr AS (SELECT DISTINCT a.p_brand AS s, b.p_brand AS t FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand)
SELECT module, file_count, coalesce(o, 0)::BIGINT AS outgoing_imports, coalesce(i, 0)::BIGINT AS incoming_imports, round((coalesce(o, 0) + coalesce(i, 0)) / file_count, 6) AS coupling_score
FROM (SELECT p_brand AS module, count(*)::BIGINT AS file_count FROM part GROUP BY 1) LEFT JOIN (SELECT s, count(*) AS o FROM pr GROUP BY 1) ON s = module LEFT JOIN (SELECT t, count(*) AS i FROM pr GROUP BY 1) ON t = module""")
def coupling(spark, sf_dir):
    ext = F.element_at(F.array(F.lit(""), F.lit(".py"), F.lit("/__init__.py")), (F.col("p_partkey") % 3 + 1).cast("int"))
    members = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("pkg/m"), "p_partkey", ext).alias("path"), F.col("p_brand").alias("module"))
    imports = edges(spark, sf_dir).select(F.col("src").alias("file_id"), F.concat(F.lit("pkg.m"), "dst").alias("module"))
    return O.coupling(members, imports).withColumn("coupling_score", F.round("coupling_score", 6))


# positions: an order is a file, its lineitems are functions, methods (even line numbers) and classes (quantity over 40)
_SYMBOLS = """sy AS (SELECT l_orderkey AS path, 'p' || l_partkey AS name, CASE WHEN l_quantity > 40 THEN 'class' WHEN l_linenumber % 2 = 0 THEN 'method' ELSE 'function' END AS kind, l_linenumber AS line, l_linenumber + l_quantity::INT AS end_line, l_suppkey::INT AS ordinal FROM lineitem)"""


def order_symbols(spark, sf_dir):
    kind = F.when(F.col("l_quantity") > 40, "class").when(F.col("l_linenumber") % 2 == 0, "method").otherwise("function")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.concat(F.lit("p"), "l_partkey").alias("name"), kind.alias("kind"), F.col("l_linenumber").alias("line"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end_line"), F.col("l_suppkey").cast("int").alias("ordinal"))


@query("hover_lookup", f"""WITH {_SYMBOLS}, pr AS (SELECT event_id, user_id AS path, (event_id % 40)::INT AS line FROM events)
SELECT event_id, path, line, coalesce(kind, 'module') AS kind, name, "start", end_line FROM (SELECT pr.event_id, pr.path, pr.line, kind, name, sy.line AS "start", end_line,
 row_number() OVER (PARTITION BY event_id ORDER BY CASE kind WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'function' THEN 3 ELSE 9 END, ordinal NULLS FIRST, sy.line NULLS FIRST, name) AS r
 FROM pr LEFT JOIN sy ON sy.path = pr.path AND pr.line BETWEEN sy.line AND sy.end_line) WHERE r = 1""")
def hover_lookup(spark, sf_dir):
    probes = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), (F.col("event_id") % 40).cast("int").alias("line"))
    return Y.at_position(probes, order_symbols(spark, sf_dir), "event_id")


@query("code_lens", "SELECT o_orderkey AS class_id, 'orders.py' AS path, (o_orderkey % 100)::INT AS line, count(l_orderkey) || ' methods' AS title FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def code_lens(spark, sf_dir):
    c = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("class_id"), F.lit("orders.py").alias("path"), (F.col("o_orderkey") % 100).cast("int").alias("line"))
    return Y.code_lenses(c, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("class_id")))


@query("workspace_symbols", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def workspace_symbols(spark, sf_dir):
    return Y.workspace_symbols(read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "RING").withColumnRenamed("name", "p_name")


_NAMES = "nm AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"


@query("symbol_search", f"""WITH {_NAMES}, q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(substr(p_name, 1 + (p_partkey % 5)::INT, 1 + (p_partkey % 7)::INT)) ELSE substr(p_name, 1 + (p_partkey % 5)::INT, 1 + (p_partkey % 7)::INT) END AS query FROM part
 UNION SELECT DISTINCT substr(s_name, 5 + (s_suppkey % 12)::INT, 6) FROM supplier UNION SELECT DISTINCT n_name FROM nation)
SELECT query, id, name FROM q JOIN nm ON contains(lower(name), lower(query)) WHERE query <> ''""")
def symbol_search(spark, sf_dir):
    """A batch of queries against an index of the names of parts, customers and suppliers."""
    t = lambda name: read(spark, sf_dir, name)
    names = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    names = names.unionByName(t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name")))
    names = names.unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    k = F.col("p_partkey")
    piece = F.substring("p_name", (k % 5 + 1).cast("int"), (k % 7 + 1).cast("int"))
    asked = t("part").select(F.when(k % 3 == 0, F.upper(piece)).otherwise(piece).alias("query"))
    asked = asked.unionByName(t("supplier").select(F.substring("s_name", (F.col("s_suppkey") % 12 + 5).cast("int"), F.lit(6)).alias("query"))).unionByName(t("nation").select(F.col("n_name").alias("query")))
    index = shared_folder(spark, "symbol-index")
    X.build(names, index)
    return X.lookup(spark, index, asked, names)


@query("definition_lookup", """WITH s AS (SELECT p_name AS name, p_partkey AS seq FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS query FROM part),
e AS (SELECT query, max(seq) AS seq FROM q JOIN s ON query = name GROUP BY query),
l AS (SELECT query, min(seq) AS seq FROM q JOIN s ON lower(query) = lower(name) WHERE query NOT IN (SELECT query FROM e) GROUP BY query)
SELECT query, seq FROM e UNION ALL SELECT query, seq FROM l""")
def definition_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    asked = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("query"))
    return Y.definitions(asked, p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))).select("query", "seq")


@query("document_symbols", f"""WITH {_SYMBOLS}, k AS (SELECT path, 'C' || (ordinal % 2) AS name, string_agg(line || '-' || end_line || ':' || name, ',' ORDER BY line, end_line, name) AS children FROM sy WHERE kind = 'method' GROUP BY 1, 2),
t AS (SELECT path, CASE WHEN kind = 'class' THEN 'C' || (ordinal % 2) ELSE name END AS name, kind, line, end_line FROM sy WHERE kind <> 'method')
SELECT t.path, t.name, t.kind, t.line, t.end_line, CASE WHEN kind = 'class' THEN children END AS children FROM t LEFT JOIN k ON k.path = t.path AND k.name = t.name""")
def document_symbols(spark, sf_dir):
    s = order_symbols(spark, sf_dir)
    c = F.concat(F.lit("C"), (F.col("ordinal") % 2).cast("string"))
    s = s.select("path", F.when(F.col("kind") == "class", c).otherwise(F.col("name")).alias("name"), "kind", "line", "end_line", F.when(F.col("kind") == "method", c).alias("container"))
    text = F.array_join(F.transform("children", lambda x: F.concat(x["line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(":"), x["name"])), ",")
    return Y.document_symbols(s).withColumn("children", text)


_INDEX = """ix AS (SELECT 0 AS part, b AS "order", b AS name, 'module' AS kind, 'modules/' || slug || '/index.html' AS path, NULL AS description, b AS module FROM (SELECT DISTINCT p_brand AS b, trim(regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM part)
UNION ALL SELECT 1, lpad(p_partkey::VARCHAR, 20, '0'), p_type || '.' || p_partkey, 'file', 'modules/' || lower(p_type) || '/index.html', p_name, p_type || '.' || p_partkey FROM part
UNION ALL SELECT 2, lpad(s_suppkey::VARCHAR, 20, '0'), s_name, 'class', 'modules/' || lower(p_type) || '/' || trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') || '.html', NULL, p_type FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT 3, lpad(c_custkey::VARCHAR, 20, '0'), c_name, 'function', 'modules/' || lower(p_type) || '/index.html', c_mktsegment, p_type FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 2 = 0)"""


def _index(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("file_id"), F.concat("p_type", F.lit("."), "p_partkey").alias("module_name"), F.col("p_name").alias("docstring"))
    classes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("class_id"), F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("docstring"))
    functions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("function_id"), F.col("c_custkey").alias("file_id"), F.when(F.col("c_custkey") % 2 == 1, F.lit(1)).alias("class_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("docstring"))
    return Y.search_index(p.select(F.col("p_brand").alias("module")).distinct(), files, classes, functions)


@query("search_index", f"WITH {_INDEX} SELECT * FROM ix")
def search_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query("site_search", f"WITH {_INDEX} SELECT * FROM ix WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(description, '')), 'ring') OR contains(lower(module), 'ring') ORDER BY part, \"order\" LIMIT 10")
def site_search(spark, sf_dir):
    return Y.site_search(_index(spark, sf_dir), "Ring")


@query("hover_text", """SELECT o_orderkey, '## class o' || o_orderkey || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Methods | ' || n || ' |' || chr(10) || '| Lines | ' || m || ' |' || chr(10) || '| File imports | 3 |' || chr(10)
 || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '---' || chr(10) || chr(10) || o_orderpriority ELSE '' END AS class_text,
 '```' || chr(10) || 'def f()' || chr(10) || '```' || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Lines | ' || m || ' |' || chr(10) || '| Complexity | ' || CASE WHEN m <= 10 THEN 'Low' WHEN m <= 30 THEN 'Medium' ELSE 'High' END || ' |' || chr(10)
 || CASE WHEN o_orderstatus = 'P' THEN '| Container | P |' || chr(10) ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '---' || chr(10) || chr(10) || o_orderpriority ELSE '' END AS function_text
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity)::BIGINT AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def hover_text(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").cast("long").alias("m"))
    st = F.col("o_orderstatus")
    o = read(spark, sf_dir, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey")).withColumns(
        {"name": F.concat(F.lit("o"), "o_orderkey"), "doc": F.when(st == "F", F.col("o_orderpriority")).when(st == "O", "  "), "imports": F.lit(3), "sig": F.lit("def f()"), "box": F.when(st == "P", "P")})
    return o.select("o_orderkey", Y.hover_class("name", "n", "m", "imports", "doc").alias("class_text"), Y.hover_function("sig", "m", "box", "doc").alias("function_text"))


# diagnostics: orders are files; open ones have an even key; rings of three successive orders are cycles
_FINDINGS = """f AS (SELECT o_orderkey AS file_id, 'src/o' || o_orderkey || '.py' AS path, CASE WHEN o_orderstatus = 'F' THEN '  ' WHEN o_orderstatus = 'O' THEN o_orderpriority END AS doc, (o_orderkey % 40)::BIGINT AS cx, (o_orderkey % 25)::BIGINT AS fc FROM orders),
op AS (SELECT path FROM f WHERE file_id % 2 = 0), rg AS (SELECT file_id // 3 AS cid, string_agg('o' || file_id || '.py', ' -> ' ORDER BY file_id) AS d, list(path ORDER BY file_id) AS ps FROM f GROUP BY 1),
fd AS (SELECT f.path, 'ERROR' AS severity, 'circular-dependency' AS code, 0 AS line, 'Circular dependency detected: ' || d AS message, array_to_string(list_filter(ps, lambda x: x <> f.path), ',') AS related FROM f JOIN rg ON cid = file_id // 3
 UNION ALL SELECT path, 'HINT', 'missing-module-docs', 0, 'Module is missing documentation', '' FROM f WHERE trim(coalesce(doc, '')) = ''
 UNION ALL SELECT path, 'HINT', 'missing-class-docs', greatest(l_linenumber - 1, 0), 'Class ''p' || l_partkey || ''' is missing documentation', '' FROM lineitem JOIN f ON file_id = l_orderkey WHERE l_returnflag = 'R'
 UNION ALL SELECT path, 'WARNING', 'high-complexity', 0, 'High complexity detected (complexity: ' || cx || ', threshold: 20). Consider splitting this module.', '' FROM f WHERE cx > 20
 UNION ALL SELECT path, 'WARNING', 'too-many-functions', 0, 'Too many functions in module (' || fc || ' functions, threshold: 15). Consider splitting this module.', '' FROM f WHERE fc > 15)"""


def order_findings(spark, sf_dir, paths=None):
    """Findings of the orders with an even key, or of those named by `paths`."""
    st, k = F.col("o_orderstatus"), F.col("o_orderkey")
    f = read(spark, sf_dir, "orders").select(k.alias("file_id"), F.concat(F.lit("src/o"), k, F.lit(".py")).alias("path"), F.when(st == "F", "  ").when(st == "O", F.col("o_orderpriority")).alias("docstring"))
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_linenumber").alias("line_start"), F.when(F.col("l_returnflag") != "R", "doc").alias("docstring"))
    m = f.select("file_id", (F.col("file_id") % 40).alias("complexity"), (F.col("file_id") % 25).alias("function_count"))
    ring = f.select(F.expr("file_id div 3").alias("cycle_id"), F.col("file_id").alias("pos"), "path")
    asked = f.filter("file_id % 2 = 0") if paths is None else f.join(paths.select("path").distinct(), "path", "left_semi")
    return G.findings(f, c, m, ring, asked), asked


@query("diagnostics", f"WITH {_FINDINGS} SELECT path, severity, code, line::INT AS line, message, related FROM op LEFT JOIN fd USING (path)")
def diagnostics(spark, sf_dir):
    return order_findings(spark, sf_dir)[0].withColumn("related", F.array_join("related", ","))


@query("published_diagnostics", f"""WITH {_FINDINGS} SELECT path, count(code)::INT AS count, coalesce(string_agg(code || '@' || line || ':' || severity, ',' ORDER BY line, code, severity, message), '') AS items, coalesce(sum(length(message)), 0)::BIGINT AS chars FROM op LEFT JOIN fd USING (path) GROUP BY path""")
def published_diagnostics(spark, sf_dir):
    found, asked = order_findings(spark, sf_dir)
    return _opened(T.published_diagnostics(found, asked))


def _opened(sent):
    """Messages read again from their JSON."""
    d = F.from_json("diagnostics", "array<struct<line int, code string, severity string, message string, related array<string>>>")
    item = F.transform(d, lambda x: F.concat(x["code"], F.lit("@"), x["line"].cast("string"), F.lit(":"), x["severity"]))
    chars = F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + F.char_length(x["message"]))
    return sent.select("path", "count", F.array_join(item, ",").alias("items"), chars.alias("chars"))


# events open, change and close ('error') the file of the order with the user's number; the last one counts
@query("publications", f"""WITH {_FINDINGS}, ev AS (SELECT 'src/o' || user_id || '.py' AS path, max_by(event_type, (ts, event_id)) <> 'error' AS is_open FROM events GROUP BY 1)
SELECT ev.path, (CASE WHEN is_open THEN count(code) ELSE 0 END)::INT AS count, CASE WHEN is_open THEN coalesce(string_agg(code || '@' || line || ':' || severity, ',' ORDER BY line, code, severity, message), '') ELSE '' END AS items,
 (CASE WHEN is_open THEN coalesce(sum(length(message)), 0) ELSE 0 END)::BIGINT AS chars FROM ev LEFT JOIN fd USING (path) GROUP BY ev.path, is_open""")
def publications(spark, sf_dir):
    """What clients have after all events: the batch form of T.publish_stream."""
    e = file_events(read(spark, sf_dir, "events"))
    newest = T.open_state(e, close="error").join(e.groupBy("path").agg(F.max(F.struct("ts", "seq")).alias("at")), "path").select("path", "at.ts", "at.seq", "event", "is_open")
    return _opened(T.publications(newest, lambda paths: order_findings(spark, sf_dir, paths)[0]))


def file_events(events):
    return events.select(F.concat(F.lit("src/o"), "user_id", F.lit(".py")).alias("path"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"))


# cache: an earlier scan lacks every fifth document, has other times for every second and other texts for every third
_CACHE = "c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS mtime, CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 > 0)"


def _scans(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", F.col("doc_id").alias("mtime"), S.content_hash("text").alias("content_hash"))
    old = d.filter("doc_id % 5 > 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(0).alias("mtime"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("content_hash")).alias("content_hash"))
    return d, old


@query("cache_hits", f"WITH {_CACHE} SELECT d.doc_id, coalesce(c.mtime = d.doc_id OR c.h = sha256(d.text), false) AS hit FROM documents d LEFT JOIN c USING (doc_id)")
def cache_hits(spark, sf_dir):
    hits, misses = K.split(*_scans(spark, sf_dir))
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("cache_prune", f"WITH {_CACHE} SELECT 'd' || doc_id AS path, mtime FROM c WHERE doc_id % 7 > 0")
def cache_prune(spark, sf_dir):
    scan, old = _scans(spark, sf_dir)
    return K.prune(old, scan.filter("doc_id % 7 > 0")).select("path", "mtime")


@query("latest_open_state", """SELECT user_id AS path, event_type AS last_event, event_type <> 'error' AS is_open FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_open_state(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    return T.open_state(e, close="error").select("path", F.col("event").alias("last_event"), "is_open")


@query("change_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS changes FROM events GROUP BY 1, 2")
def change_rate(spark, sf_dir):
    return T.change_rate(read(spark, sf_dir, "events"), "ts", "event_type", "1 hour").select(F.col("window_start").alias("hour"), "event_type", "changes")
