"""Queries of upkeep: the state of an earlier project and signed changes give the state of a later one.

Parts are files. The earlier project has the parts up to size 40 and the imports of orders before 1996; the later one the parts above
size 5 and the imports of orders that are not pending. So files and imports both come and go.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import deltas as D
from .registry import query, read

_LATER = """im AS (SELECT src, dst FROM (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey WHERE dst IS NOT NULL AND src <> dst AND o_orderstatus <> 'P'),
e AS (SELECT src, dst, a.p_brand AS from_home, b.p_brand AS to_home FROM im JOIN part b ON b.p_partkey = dst JOIN part a ON a.p_partkey = src WHERE b.p_size > 5)"""


def _versions(spark, sf_dir):
    """imports (src, module), names (module, dst) of both projects, and homes."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null and src <> dst")
    both = li.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus"), "l_orderkey")
    imports = lambda rows: rows.select("src", F.concat(F.lit("m"), "dst").alias("module"))
    part = read(spark, sf_dir, "part")
    names = lambda rows: rows.select(F.concat(F.lit("m"), "p_partkey").alias("module"), F.col("p_partkey").alias("dst"))
    homes = part.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("home"))
    return imports(both.filter("o_orderdate < timestamp '1996-01-01'")), imports(both.filter("o_orderstatus <> 'P'")), names(part.filter("p_size <= 40")), names(part.filter("p_size > 5")), homes


@query("upkeep_after_save", f"""WITH {_LATER} SELECT 'out' AS kind, src::VARCHAR AS key, count(*)::BIGINT AS n FROM e GROUP BY src UNION ALL SELECT 'in', dst::VARCHAR, count(*) FROM e GROUP BY dst
UNION ALL SELECT 'between', from_home || '>' || to_home, count(*) FROM e GROUP BY from_home, to_home UNION ALL SELECT 'edge', src || '>' || dst, count(*) FROM e GROUP BY src, dst""")
def upkeep_after_save(spark, sf_dir):
    imports, later_imports, names, later_names, homes = _versions(spark, sf_dir)
    s = D.ImportState(imports, names, homes).after(D.difference(imports, later_imports), D.difference(names, later_names))
    text = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(">"), F.col(b).cast("string"))
    out = s.out.select(F.lit("out").alias("kind"), F.col("src").cast("string").alias("key"), "n")
    out = out.unionByName(s.into.select(F.lit("in").alias("kind"), F.col("dst").cast("string").alias("key"), "n"))
    out = out.unionByName(s.between.select(F.lit("between").alias("kind"), text("from_home", "to_home").alias("key"), "n"))
    return out.unionByName(s.edges.select(F.lit("edge").alias("kind"), text("src", "dst").alias("key"), F.col(D.SIGN).alias("n")))
