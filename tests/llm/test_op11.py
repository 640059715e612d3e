from __future__ import annotations

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import op11_merkle_manifest as op11

DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text=None):
    text = r[1] if text is None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def reduce(nodes):
    """The top of the nodes, and for each its siblings level by level as (before, after)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append((run[: k % 3], run[k % 3 + 1 :]))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], paths


def brute(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in sources:
        group = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        done[s] = group, *reduce([plain_leaf(r) for r in group])
    root, upper = reduce([done[s][1] for s in sources])
    for s, above in zip(sources, upper, strict=True):
        group, subroot, paths = done[s]
        for r, path in zip(group, paths, strict=True):
            path, tampered = path + above, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = plain_leaf(r, r[1].replace("\n", "")) if tampered and r[1] is not None else plain_leaf(r)
            for a, b in path:
                at = sha("".join([*a, at, *b]))
            out.append((r[0], plain_leaf(r), subroot, root, sha("".join("".join([*a, *b]) for a, b in path)), at, at == root))
    return sorted(out, key=str)


def test_crc_sql():
    import duckdb

    for n in (0, 7, 12345, -20, 2**62):
        assert duckdb.sql(f"SELECT {op11.CRC_SQL.format('x')} FROM (SELECT {n}::BIGINT AS x)").fetchall()[0][0] == zlib.crc32(str(n).encode())


def query(spark, df, tmp_path, name):
    df.write.mode("overwrite").parquet(str(tmp_path / name / "documents.parquet"))
    return op11.op11_merkle_manifest(spark, str(tmp_path / name))


ROWS = [(i, f"text {i}\nend" if i % 3 else "plain", "en", f"s{i % 4 if i % 5 else 0}", i, None, "x", None) for i in range(90)] + [
    (None, "a\n", None, None, None, None, None, None), (None, "a\n", None, None, None, "x", None, None), (2**60 + 1, "", "é", "", 3, None, None, None),
    (5, None, "en", "s0", 1, None, None, None), (5, "\n" * 5000, "en", "s0", 1, None, None, None), (5, "\n" * 5000, "en", "s0", 1, "other", None, None), (-4, "x\ny", "de", "ü", 2, None, None, None),
]


@pytest.mark.parametrize("levels", (1, 2, 7))
def test_equals_brute_force(spark, tmp_path, levels, monkeypatch):
    monkeypatch.setattr(op11.manifest, "__defaults__", (None, 3, levels))
    got = query(spark, spark.createDataFrame(ROWS, DDL).repartition(3), tmp_path, "d")
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:5] for r in ROWS])
    assert {False, True} == {r.verified for r in got.select("verified").collect()}


def test_small_and_empty(spark, tmp_path):
    for k, rows in enumerate(([], ROWS[:1], ROWS[90:92], [ROWS[96]], [ROWS[92], ROWS[96]])):
        got = query(spark, spark.createDataFrame(rows, DDL), tmp_path, str(k))
        assert sorted(map(tuple, got.collect()), key=str) == (brute([r[:5] for r in rows]) if rows else [])


def test_proofs_hold_for_every_leaf_and_no_other(spark):
    m = op11.manifest(spark.createDataFrame(ROWS, DDL), levels=2)
    kept = m.withColumn("again", op11.fold(m.leaf, m.left, m.right)).withColumn("wrong", op11.fold(m.root, m.left, m.right))
    assert kept.filter("again <> root").count() == 0 and kept.filter("wrong = root and size(left) > 0").count() == 0
    assert m.groupBy("source").count().count() == m.select("source", "subroot").distinct().count()


def test_equal_rows_spread_over_ranges(spark):
    """A hot source of equal rows without doc_id is not one range."""
    rows = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'1s' as key", "'d' as digest", "monotonically_increasing_id() as row")
    parts = op11.numbered(rows, "key", "doc_id", "digest", "row")
    assert parts.agg({"pos": "max"}).first()[0] == 19_999 and parts.select("pos").distinct().count() == 20_000
    ranged = rows.repartitionByRange(4, "key", "doc_id", "digest", "row")
    sizes = [n for (n,) in ranged.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 9_000


def test_tower():
    for n, k in itertools.product((1, 2, 3, 4, 9, 10), (1, 2)):
        levels = op11.tower([str(i) for i in range(n)], 3, k)
        assert [len(x) for x in levels] == [n, *[-(-n // 3 ** (i + 1)) for i in range(k)]]
    assert [op11.height(n, 3) for n in (1, 2, 3, 4, 9, 10)] == [0, 1, 1, 2, 2, 3]
