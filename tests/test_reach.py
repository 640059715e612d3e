"""Reach by bit sets, position lookup by cells, search by grams: against plain versions."""

from __future__ import annotations

import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens import session as S
from quarrylens.operators import reach as R
from quarrylens.operators import search as X
from quarrylens.operators import symbols as Y
from quarrylens.plans import registry


def plain_reach(pairs, starts, depth):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for s in starts:
        seen, level, d = {s}, {s}, 0
        while level and (depth is None or d < depth):
            d += 1
            level = {y for x in level for y in ahead.get(x, ())} - seen
            seen |= level
            out |= {(s, x, d) for x in level}
    return out


@pytest.mark.parametrize("depth", (1, 3, None))
def test_reach_of_many_starts(spark, depth):
    """More starts than a block has lanes, some of them no file of an edge."""
    rnd = random.Random(depth)
    pairs = [(rnd.randrange(1500), rnd.randrange(1500)) for _ in range(6000 if depth is None else 1600)] + [(7, 7), (2**40, 3), (3, 2**40)]
    starts = [*range(0, 1500), 2**40, -5, 3, 3]
    e = spark.createDataFrame(pairs, "src long, dst long")
    s = spark.createDataFrame([(x,) for x in [*starts, None]], "file_id long")
    want = plain_reach(pairs, set(starts), depth)
    got = [tuple(r) for r in R.transitive_imports(e, s, depth).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {}
    for _, x, _ in want:
        counts[x] = counts.get(x, 0) + 1
    assert {r.file_id: r.dependents for r in R.reach_counts(e, s, depth).collect()} == counts


def test_reach_of_nothing(spark):
    e, none = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([], "file_id long")
    assert R.transitive_imports(e, none, 3).count() == 0 and R.transitive_imports(e.limit(0), e.select(F.col("src").alias("file_id")), None).count() == 0
    assert R.reach_counts(e, none).count() == 0


def test_bits_are_unpacked_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "UNPACKED", 8)
    pairs = [(0, i) for i in range(1, 200)]
    got = R.transitive_imports(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,), (5,)], "file_id long"), 2)
    assert sorted(map(tuple, got.collect())) == [(0, i, 1) for i in range(1, 200)]


@pytest.mark.parametrize("held", (0, 60, 10**6))
@pytest.mark.parametrize("depth", (3, None))
def test_balls_and_shuffled_levels_agree(spark, monkeypatch, held, depth):
    """Two groups of files, a dense and a sparse one: by HELD all, one or no balls are taken apart by levels, and only those."""
    rnd, real, asked = random.Random(held), R.levels, []
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "BALL", 20)
    monkeypatch.setattr(R, "levels", lambda e, lanes, d=None: asked.append(lanes.count()) or real(e, lanes, d))
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(300)] + [(i, i + 1) for i in range(100, 130)] + [(500, 500)]
    e, s = spark.createDataFrame(pairs * 2, "src long, dst long"), spark.createDataFrame([(x,) for x in {a for a, _ in pairs}], "file_id long")
    want = plain_reach(pairs, {a for a, _ in pairs}, depth)
    assert sorted(map(tuple, R.transitive_imports(e, s, depth).collect())) == sorted(want)
    assert {(r.file_id, r.dependents) for r in R.reach_counts(e, s, depth).collect()} == {(x, sum(y == x for _, y, _ in want)) for _, x, _ in want}
    assert bool(asked) == (held < 10**6) and (held != 60 or max(asked) < len({a for a, _ in pairs}))


def test_edges_shuffle_what_decides_them(spark, tmp_path):
    """Ties up to the supplier: the same edges as by the SQL's order, without the supplier in the plan."""
    rnd = random.Random(5)
    lines = [(rnd.randrange(40), rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(9)]), rnd.randrange(4)) for _ in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    queries = registry.graph_queries
    got = queries.edges(spark, str(tmp_path))
    want = duckdb.execute(f"WITH {queries.EDGES_SQL.replace('FROM lineitem', f"FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")} SELECT src, dst FROM edges").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert "l_suppkey" not in got._jdf.queryExecution().executedPlan().toString()


def test_written_leaves_no_shuffle_on_disk(spark):
    def shuffles():
        return {p for top in Path(spark.sparkContext._jvm.java.lang.System.getProperty("java.io.tmpdir")).glob("blockmgr-*") for p in top.glob("*/shuffle_*")}

    before, switch = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = S.written(spark.range(20_000).withColumn("k", F.col("id") % 7).repartition(3, "k").groupBy(F.col("id") % 11).agg(F.count("*").alias("n")))
    for _ in range(100):  # files are removed by another thread
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and got.agg(F.sum("n")).first()[0] == 20_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == switch


def plain_at(probes, symbols):
    rank = {"method": 1, "class": 2, "function": 3}
    out = []
    for key, path, line in probes:
        hits = [(rank.get(k, 9), o, a, n, k, b) for n, k, p, a, b, o in symbols if p == path and path is not None and line is not None and a <= line <= b]
        best = min(hits) if hits else None
        out.append((key, path, line, best[4], best[3], best[2], best[5]) if best else (key, path, line, "module", None, None, None))
    return sorted(out, key=str)


SYMBOLS = "name string, kind string, path string, line int, end_line int, ordinal int"


def test_position_lookup(spark):
    rnd = random.Random(1)
    symbols = []
    for i in range(300):
        a = rnd.randrange(200)
        symbols.append((f"n{i}", rnd.choice(["method", "class", "function", "other"]), f"p{rnd.randrange(3)}", a, a + rnd.choice([0, 1, 2, 7, 64, 130, -3]), i))
    symbols += [("whole", "function", "p0", 0, 2**31 - 1, 999), ("none", "class", None, 1, 5, 1), ("low", "class", "p2", -9, -4, 1)]
    probes = [(k, rnd.choice(["p0", "p1", "p2", "p3"]), rnd.choice([rnd.randrange(-10, 340), 2**31 - 1])) for k in range(400)] + [(400, None, 3), (401, "p0", None), (0, "p0", 7)]
    got = Y.at_position(spark.createDataFrame(probes, "k int, path string, line int"), spark.createDataFrame(symbols, SYMBOLS), "k")
    assert sorted(map(tuple, got.collect()), key=str) == plain_at(probes, symbols)
    assert Y.at_position(spark.createDataFrame(probes, "k int, path string, line int"), spark.createDataFrame([], SYMBOLS), "k").filter("kind <> 'module'").count() == 0


def test_one_large_file_makes_no_product(spark):
    """100,000 nested symbols and as many probes of one file: cells keep one symbol each, so no join grows with their product."""
    n = 100_000
    symbols = spark.range(n).selectExpr("concat('f', id) name", "'function' kind", "'one.py' path", "cast(id as int) line", f"cast({2 * n} - id as int) end_line", f"cast({n} - id as int) ordinal")
    probes = spark.range(n).selectExpr("id k", "'one.py' path", "cast(id * 2 as int) line")
    got = Y.at_position(probes, symbols, "k").agg(F.sum("start"), F.count("name")).first()
    assert got[0] == sum(min(2 * i, 2 * n - 2 * i, n - 1) for i in range(n)) and got[1] == n


@pytest.mark.parametrize("size,meet", ((3, 2), (10_000, 1), (10_000, 3)))
def test_search_equals_scan(spark, tmp_path, size, meet):
    rnd = random.Random(size)
    names = [(i, "".join(rnd.choice("abAB_é") for _ in range(rnd.randrange(9)))) for i in range(400)] + [(400, None), (401, ""), (402, "aaaaaaaa"), (403, "aaaaaaaa"), (404, "İx%_\\")]
    queries = ["".join(rnd.choice("abB_é") for _ in range(rnd.randrange(1, 6))) for _ in range(60)] + ["", None, "a", "zz", "zzzz", "AAAA", "x%_\\", "_", "%"]
    n, q = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(x,) for x in queries + queries[:5]], "query string")
    X.build(n, str(tmp_path / "index"), list_size=size)
    got = X.lookup(spark, str(tmp_path / "index"), q, n, meet)
    want = q.distinct().filter("query <> ''").join(n, F.contains(F.lower("name"), F.lower("query"))).select("query", "id", "name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    lists = spark.read.parquet(str(tmp_path / "index" / "lists"))
    assert size > 3 or lists.filter("n > 30").groupBy("gram").agg(F.max(F.size("ids")).alias("m"), F.max("n").alias("n")).filter("m > n / 3").count() == 0
    X.build(n.limit(0), str(tmp_path / "none"))
    assert X.lookup(spark, str(tmp_path / "none"), q, n).count() == 0


def test_equal_names_are_searched_once(spark, tmp_path, monkeypatch):
    """Many ids of few names: the index has each name once, and lists of ids and queries are cut."""
    monkeypatch.setattr(X, "LIST", 50)
    monkeypatch.setattr(X, "ASKED", 2)
    words = ["hot bolt", "Hot bolt", "large ring", "blue ring", None, ""]
    names = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("id"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 6 + 1).cast("int")).alias("name"))
    q = spark.createDataFrame([(x,) for x in ("bolt", "RING", "r", "e ri", "zz", "t", "", None, "bolt")], "query string")
    X.build(names, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "lists")).agg(F.max("n")).first()[0] <= 4
    got = sorted(map(tuple, X.lookup(spark, str(tmp_path / "index"), q, names).collect()))
    want = q.distinct().filter("query <> ''").join(names, F.contains(F.lower("name"), F.lower("query"))).select("query", "id", "name")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 500 * (2 + 2 + 2 + 2 + 2)


def test_packed_imports_keep_every_file():
    rnd = random.Random(3)
    ids = [0, 1, 255, 256, 2**16, 2**32, -(2**63), 2**63 - 1, *(rnd.randrange(-(10**6), 10**6) for _ in range(300))]
    pairs = [(rnd.choice(ids[:40]), rnd.choice(ids)) for _ in range(2000)]
    batch = R._packed(*(np.array(x, np.int64) for x in zip(*pairs)))
    row, dst = R._unpacked(batch)
    assert list(zip(batch["src"].to_numpy()[row].tolist(), dst.tolist())) == sorted(set(pairs))
    none = R._packed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(none) == 0 and len(R._unpacked(none)[1]) == 0


def test_edges_in_rounds(spark, sf, monkeypatch):
    queries, names = registry.graph_queries, ("import_reach", "dependents", "transitive_imports")
    want = [sorted(map(tuple, registry.QUERIES[n](spark, sf).collect())) for n in names]
    monkeypatch.setattr(queries, "ROUND", 2_500)
    rounds = queries.edge_rounds(spark, sf)
    assert len(rounds) == 3 and sorted(tuple(r) for e in rounds for r in e.collect()) == sorted(map(tuple, queries.edges(spark, sf).collect()))
    assert [sorted(map(tuple, registry.QUERIES[n](spark, sf).collect())) for n in names] == want


def test_reach_makes_small_tables(spark, tmp_path):
    """Files that reach each other: a table of all pairs takes a small part of a byte for each."""
    rnd, n = random.Random(9), 1500
    e = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(8 * n)], "src long, dst long")
    R.import_reach(e, e.select(F.col("src").alias("file_id"))).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == n * (n - 1)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < n * (n - 1) / 4
