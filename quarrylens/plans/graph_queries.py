"""Queries of the graph operators on the graph of parts: successive parts of an order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..operators import diagrams as D
from ..operators import graph as G
from ..operators import reach as R
from .registry import query, read

EDGES_SQL = """edges AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


#: Lines whose edges are shuffled at a time.
ROUND = 12_000_000


def edges(spark, sf_dir):
    return _edges(read(spark, sf_dir, "lineitem"))


def edge_rounds(spark, sf_dir):
    """The edges of all orders in parts, by a hash of the order: each part is shuffled when its turn comes."""
    li = read(spark, sf_dir, "lineitem")
    n = -(-li.count() // ROUND) or 1
    return [_edges(li.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(n)) == k)) for k in range(n)]


def _edges(li):
    """Lines that are equal up to l_suppkey have one part, so their order among each other changes no edge, and l_suppkey is not shuffled."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_partkey")))
    return li.select(F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null and src <> dst")


def importers(spark, sf_dir):
    """Parts of all lines, for starts of reach: those without a next part import nothing and reach nothing."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"))


def files(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey").alias("module_name"))


def module_of(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("module"))


FILES_SQL = "files AS (SELECT p_partkey AS file_id, p_brand AS module, replace(p_brand, '#', '.') || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS module_name FROM part)"


@query("graph_stats", f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM part)::BIGINT AS files, (SELECT sum(p_size) FROM part)::BIGINT AS total_lines, (SELECT sum(p_size // 2) FROM part)::BIGINT AS code_lines, (SELECT count(*) FROM orders)::BIGINT AS classes, (SELECT count(*) FROM lineitem)::BIGINT AS functions, (SELECT count(*) FROM edges)::BIGINT AS edges")
def graph_stats(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("cast(p_size as long) total_lines", "cast(p_size div 2 as long) code_lines")
    return G.stats(f, read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), edges(spark, sf_dir))


@query("labelled_edges", f"WITH {EDGES_SQL}, {FILES_SQL} SELECT a.module_name AS src_module_name, b.module_name AS dst_module_name FROM edges JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id")
def labelled_edges(spark, sf_dir):
    return G.labelled(edges(spark, sf_dir), files(spark, sf_dir), "module_name").select("src_module_name", "dst_module_name")


@query("out_neighbors", f"WITH {EDGES_SQL} SELECT src AS file_id, dst AS imported FROM edges WHERE src IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def out_neighbors(spark, sf_dir):
    asked = read(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("file_id"))
    return G.imports_of(edges(spark, sf_dir), asked)


@query("in_neighbors", f"WITH {EDGES_SQL} SELECT dst AS file_id, src AS importer FROM edges WHERE dst IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def in_neighbors(spark, sf_dir):
    asked = read(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("file_id"))
    return G.imported_by(edges(spark, sf_dir), asked)


@query("dependency_count", f"WITH {EDGES_SQL} SELECT p_partkey AS file_id, count(src)::BIGINT AS dependency_count FROM part LEFT JOIN edges ON src = p_partkey GROUP BY p_partkey")
def dependency_count(spark, sf_dir):
    return G.dependency_count(edges(spark, sf_dir), files(spark, sf_dir))


@query("transitive_imports", f"""WITH RECURSIVE {EDGES_SQL}, r(start, file_id, depth) AS (SELECT DISTINCT src, dst, 1 FROM edges
  UNION SELECT start, dst, depth + 1 FROM r JOIN edges ON src = file_id WHERE depth < 3)
SELECT start, file_id, min(depth)::INT AS depth FROM r WHERE start <> file_id GROUP BY start, file_id""")
def transitive_imports(spark, sf_dir):
    return R.transitive_imports(edge_rounds(spark, sf_dir), importers(spark, sf_dir), 3)


@query("import_reach", f"""WITH RECURSIVE {EDGES_SQL}, r(start, file_id) AS (SELECT DISTINCT src, src FROM edges WHERE src % 20 = 0 UNION SELECT start, dst FROM r JOIN edges ON src = file_id)
SELECT * FROM r WHERE start <> file_id""")
def import_reach(spark, sf_dir):
    """Search: what each part with a number divisible by 20 reaches, in any number of steps."""
    return R.import_reach(edge_rounds(spark, sf_dir), importers(spark, sf_dir).filter("file_id % 20 = 0"))


@query("dependents", f"""WITH RECURSIVE {EDGES_SQL}, d AS (SELECT DISTINCT src, dst FROM edges), r(start, file_id, depth) AS (SELECT DISTINCT src, src, 0 FROM d UNION SELECT start, dst, depth + 1 FROM r JOIN d ON src = file_id WHERE depth < 2)
SELECT file_id, count(DISTINCT start)::BIGINT AS dependents FROM r WHERE start <> file_id GROUP BY file_id""")
def dependents(spark, sf_dir):
    return R.reach_counts(edge_rounds(spark, sf_dir), importers(spark, sf_dir), 2)


@query("cyclic_members", f"""WITH RECURSIVE {EDGES_SQL}, r(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b),
m AS (SELECT x.a AS file_id, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)
SELECT file_id, least(file_id, min(other)) AS component FROM m GROUP BY file_id""")
def cyclic_members(spark, sf_dir):
    return G.strong_components(edges(spark, sf_dir))


def _tree_sql(name: str, a: str, b: str) -> str:
    """Breadth-first levels from each component's least file over inner edges a -> b, parents (the least of those one step nearer) and ways."""
    return f"""{name}_d(v, component, d) USING KEY (v) AS (SELECT DISTINCT component, component, 0 FROM inn
  UNION SELECT i.{b}, any_value(i.component), min(x.d + 1) FROM {name}_d x JOIN inn i ON i.{a} = x.v WHERE i.{b} NOT IN (SELECT v FROM recurring.{name}_d) GROUP BY i.{b}),
{name}_p AS (SELECT i.{b} AS v, min(i.{a}) AS p FROM inn i JOIN {name}_d x ON x.v = i.{a} JOIN {name}_d y ON y.v = i.{b} AND y.d = x.d + 1 GROUP BY i.{b}),
{name}(v, way) AS (SELECT DISTINCT component, [component] FROM inn UNION ALL SELECT q.v, list_append(way, q.v) FROM {name} t JOIN {name}_p q ON q.p = t.v)"""


@query("canonical_cycles", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON src = b),
comp AS (SELECT x.a AS v, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
inn AS (SELECT src, dst, a.component FROM e JOIN comp a ON a.v = src JOIN comp b ON b.v = dst AND b.component = a.component), {_tree_sql("o", "src", "dst")}, {_tree_sql("u", "dst", "src")},
w AS (SELECT component, o.way AS there, list_reverse(u.way) AS back FROM inn JOIN o ON o.v = src JOIN u ON u.v = dst),
m AS (SELECT *, list_filter(back, lambda z: list_contains(there, z))[1] AS x FROM w),
g AS (SELECT DISTINCT component, list_concat(back[1:list_position(back, x)], there[list_position(there, x) + 1:]) AS ring FROM m)
SELECT DISTINCT component, array_to_string(list_concat(ring[list_position(ring, list_min(ring)):], ring[1:list_position(ring, list_min(ring)) - 1]), '->') AS cycle FROM g""")
def canonical_cycles(spark, sf_dir):
    return G.cycles(edges(spark, sf_dir)).select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), "->").alias("cycle"))


@query("module_edges", f"WITH {EDGES_SQL}, {FILES_SQL} SELECT DISTINCT a.module AS from_module, b.module AS to_module FROM edges JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id WHERE a.module <> b.module")
def module_edges(spark, sf_dir):
    return G.module_edges(edges(spark, sf_dir), module_of(spark, sf_dir))


@query("module_internal_edges", f"WITH {EDGES_SQL}, {FILES_SQL} SELECT a.module, src, dst FROM edges JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id WHERE a.module = b.module")
def module_internal_edges(spark, sf_dir):
    return G.internal_edges(edges(spark, sf_dir), module_of(spark, sf_dir))


@query("dedup_edges", f"WITH {EDGES_SQL} SELECT DISTINCT src, dst FROM edges")
def dedup_edges(spark, sf_dir):
    return edges(spark, sf_dir).distinct()


@query("export_filter_glob", "SELECT p_partkey AS file_id, p_brand AS module FROM part WHERE (starts_with(p_brand, 'Brand#1') OR ends_with(p_brand, '5') OR p_brand = 'Brand#7') AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def export_filter_glob(spark, sf_dir):
    project = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"))
    return G.filter_files(module_of(spark, sf_dir), ("Brand#1*", "*5", "Brand#7"), project=project)


def _style(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{a}') THEN '{b}'" for a, b in pairs) + f" ELSE '{default}' END"


_ID = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"
_P = lambda x: f"lpad({x}::VARCHAR, 20, '0')"


@query("mermaid_lines", f"""WITH {EDGES_SQL}, {FILES_SQL} SELECT 0 AS part, '0000' AS key, 'graph TB' AS line
UNION ALL SELECT 1, {_P("file_id")}, '    ' || {_ID("module_name")} || '[' || string_split(module_name, '.')[-1] || ']' || {_style("lower(module_name)", N.STYLES, "")} FROM files
UNION ALL SELECT 2, {_P("src")} || {_P("dst")}, '    ' || {_ID("a.module_name")} || ' --> ' || {_ID("b.module_name")} FROM (SELECT DISTINCT * FROM edges) JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id""")
def mermaid_lines(spark, sf_dir):
    return D.dependency_graph(files(spark, sf_dir), edges(spark, sf_dir))


_MODULE_LEVEL = f"""SELECT 0 AS part, '0000' AS key, 'graph TB' AS line
UNION ALL SELECT 1, module, '    ' || {_ID("module")} || '["' || module || '\\n(' || count(*) || ' files)"]' FROM files GROUP BY module
UNION ALL SELECT 2, f || chr(9) || t, '    ' || {_ID("f")} || ' --> ' || {_ID("t")} FROM (SELECT DISTINCT a.module AS f, b.module AS t FROM edges JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id WHERE a.module <> b.module)"""


@query("mermaid_module_lines", f"WITH {EDGES_SQL}, {FILES_SQL} {_MODULE_LEVEL}")
def mermaid_module_lines(spark, sf_dir):
    return D.adaptive_graph(files(spark, sf_dir), module_of(spark, sf_dir), edges(spark, sf_dir))  # more than 100 files


@query("mermaid_one_module", f"""WITH {EDGES_SQL}, {FILES_SQL}, own AS (SELECT * FROM files WHERE module = 'Brand#3')
SELECT 0 AS part, '0000' AS key, 'graph TB' AS line UNION ALL SELECT 0, '0001', '    subgraph Brand_3 [Brand#3]' UNION ALL SELECT 2, '0000', '    end'
UNION ALL SELECT 1, {_P("file_id")}, '        ' || {_ID("module_name")} || '[' || module_name || '.py]' FROM own
UNION ALL SELECT 3, {_P("src")} || {_P("dst")}, '    ' || {_ID("a.module_name")} || ' --> ' || {_ID("b.module_name")} FROM edges JOIN own a ON src = a.file_id JOIN own b ON dst = b.file_id""")
def mermaid_one_module(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("path", F.concat(F.lit("src/"), "module_name", F.lit(".py")))
    return D.module_graph("Brand#3", f, module_of(spark, sf_dir), edges(spark, sf_dir))


_DOT_HEAD = """SELECT 0 AS part, '0000' AS key, 'digraph dependencies {' AS line UNION ALL SELECT 0, '0001', '    rankdir=TB;' UNION ALL SELECT 0, '0002', '    node [shape=box, style=filled, fontname="Helvetica"];'
UNION ALL SELECT 0, '0003', '    edge [color="#666666"];' UNION ALL SELECT 0, '0004', '' UNION ALL SELECT 2, '0000', '' UNION ALL SELECT 4, '0000', '}'"""
_DOT_NODE = f"'f' || file_id || ' [label=\"' || string_split(module_name, '.')[-1] || '\", fillcolor=\"' || {_style('module', N.COLOURS, N.PLAIN_COLOUR)} || '\"];'"
_DOT_EDGE = f"SELECT 3, {_P('src')} || {_P('dst')}, '    f' || src || ' -> f' || dst || ';' FROM (SELECT DISTINCT * FROM edges)"


@query("dot_lines", f"WITH {EDGES_SQL}, {FILES_SQL} {_DOT_HEAD} UNION ALL SELECT 1, {_P('file_id')}, '    ' || {_DOT_NODE} FROM files UNION ALL {_DOT_EDGE}")
def dot_lines(spark, sf_dir):
    return D.dot(files(spark, sf_dir), module_of(spark, sf_dir), edges(spark, sf_dir))


@query("dot_clusters", f"""WITH {EDGES_SQL}, {FILES_SQL} {_DOT_HEAD} UNION ALL SELECT 1, module, '    subgraph cluster_' || translate(module, './- ', '____') || ' {{' || chr(10) || '        label="' || module || '";' || chr(10) || '        style=filled;' || chr(10) || '        color=lightgrey;' || chr(10)
 || string_agg('        ' || {_DOT_NODE}, chr(10) ORDER BY file_id) || chr(10) || '    }}' FROM files GROUP BY module UNION ALL {_DOT_EDGE}""")
def dot_clusters(spark, sf_dir):
    return D.dot(files(spark, sf_dir), module_of(spark, sf_dir), edges(spark, sf_dir), cluster=True)


@query("mermaid_export", f"""WITH {EDGES_SQL}, {FILES_SQL} SELECT 0 AS part, '0000' AS key, 'graph TB' AS line
UNION ALL SELECT 1, module, '    subgraph ' || translate(module, './- ', '____') || '[' || module || ']' || chr(10) || string_agg('        ' || translate(module_name, './- ', '____') || '[' || string_split(module_name, '.')[-1] || ']', chr(10) ORDER BY file_id) || chr(10) || '    end' FROM files GROUP BY module
UNION ALL SELECT 2, {_P("src")} || {_P("dst")}, '    ' || translate(a.module_name, './- ', '____') || ' --> ' || translate(b.module_name, './- ', '____') FROM (SELECT DISTINCT * FROM edges) JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id""")
def mermaid_export(spark, sf_dir):
    return D.mermaid(files(spark, sf_dir), module_of(spark, sf_dir), edges(spark, sf_dir), cluster=True)


@query("class_hierarchy", """SELECT 0 AS part, '0000' AS key, 'classDiagram' AS line UNION ALL SELECT 0, '0001', '    direction TB'
UNION ALL SELECT 1, lpad(o_orderkey::VARCHAR, 20, '0'), '    class Order' || o_orderkey || ' {' || chr(10) || string_agg(CASE WHEN rn <= 5 THEN '        ' || CASE WHEN l_returnflag = 'R' THEN '-_m' ELSE '+m' END || l_partkey || '()' END, chr(10) ORDER BY rn)
 || CASE WHEN count(*) > 5 THEN chr(10) || '        +... ' || (count(*) - 5) || ' more' ELSE '' END || chr(10) || '    }' || chr(10) || '    ' || CASE o_orderstatus WHEN 'F' THEN 'Base' ELSE 'Other_1' END || ' <|-- Order' || o_orderkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey, o_orderstatus""")
def class_hierarchy(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag"))
    m = li.select(F.col("l_orderkey").alias("class_id"), rn.alias("ordinal"), F.concat(F.when(F.col("l_returnflag") == "R", "_m").otherwise("m"), "l_partkey").alias("name"))
    o = read(spark, sf_dir, "orders").join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    c = o.select(F.col("o_orderkey").alias("class_id"), F.concat(F.lit("shop.Order"), "o_orderkey").alias("name"), F.array(F.when(F.col("o_orderstatus") == "F", "pkg.Base").otherwise("Other_1")).alias("bases"))
    return D.class_hierarchy(c, m)
