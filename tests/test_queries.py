"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quarrylens.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(pdf, cols):
    def text(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    for c in cols:  # integers with nulls come as floats from one side only
        if str(got[c].dtype) != str(want[c].dtype) and "float" in (str(got[c].dtype) + str(want[c].dtype)).lower():
            got[c], want[c] = got[c].astype("Float64").astype(object), want[c].astype("Float64").astype(object)
            got[c], want[c] = (x[c].map(lambda v: None if v is None or v is duckdb or str(v) == "<NA>" else float(v)) for x in (got, want))
    assert rows(got, cols) == rows(want, cols)


def test_entry_and_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and set(ORACLES) <= set(o)
