"""Queries over whole tables: no part of the orders is left out."""

from __future__ import annotations

import random

import duckdb
import pytest

from quarrylens.operators import graph as G
from quarrylens.plans.registry import ORACLES, QUERIES

from .test_queries import TABLES

EDGES = "SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def assert_cycles(pairs, found):
    """Simple rings of given edges, each once and from its least id, that together have every edge inside a component."""
    edges, seen = {p for p in pairs if p[0] != p[1]}, set()
    assert len({tuple(c) for c in found}) == len(found)
    for c in found:
        ring = set(zip(c, c[1:] + c[:1], strict=True))
        assert len(c) > 1 and len(set(c)) == len(c) and c[0] == min(c) and ring <= edges
        seen |= ring
    reach = {a: {y for x, y in edges if x == a} for a, _ in edges}
    for k in reach:
        for a in reach:
            if k in reach[a]:
                reach[a] |= reach[k]
    assert seen == {(a, b) for a, b in edges if a in reach.get(b, ())}


def test_cycles_have_every_cyclic_import(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(20)] + [(20, 21), (21, 22), (22, 20), (22, 23), (30, 31), (31, 30), (31, 31)]
    frame = spark.createDataFrame(pairs, "src long, dst long")
    assert_cycles(pairs, [r.cycle for r in G.cycles(frame).collect()])


def test_canonical_cycles_of_all_orders(spark, sf, duck):
    pairs = duck.execute(f"SELECT DISTINCT src, dst FROM ({EDGES})").fetchall()
    assert_cycles(pairs, [list(map(int, r.cycle.split("->"))) for r in QUERIES["canonical_cycles"](spark, sf).collect()])


@pytest.mark.parametrize("name", ["graph_stats", "import_edges", "diagnostics"])
def test_sql_reads_whole_tables(name):
    assert "%" not in ORACLES[name].split("FROM lineitem")[1][:40] and "file_id < 300" not in ORACLES[name]


def test_edges_are_those_of_all_orders(spark, sf, duck):
    n = duck.execute(f"SELECT count(*) FROM ({EDGES})").fetchone()[0]
    assert QUERIES["graph_stats"](spark, sf).first()["edges"] == n
