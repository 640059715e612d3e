from __future__ import annotations

import math
from fractions import Fraction
from types import SimpleNamespace

import numpy as np

from quarrylens.llm import op13_pivot_search as op13

DDL = "vec_id long, embedding array<float>, label int, score string, cell string"


def brute(rows, k=10, every=100):
    usable = [(v, [math.floor(Fraction(c) * 1024) for c in x]) for v, x in rows]
    out = []
    for i, (own, q) in enumerate(usable):
        if own % every == 0:
            found = [(-min(max(sum(a * b for a, b in zip(q, x, strict=True)), op13.LEAST), op13.LARGEST), v, j) for j, (v, x) in enumerate(usable) if j != i]
            out += [(own, r + 1, v, -s) for r, (s, v, _) in enumerate(sorted(found)[:k])]
    return sorted(out)


def query(spark, rows, tmp_path, name, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score string, cell string").repartition(3)
    df.write.mode("overwrite").parquet(str(tmp_path / name / "embeddings.parquet"))
    return op13.op13_pivot_search(spark, str(tmp_path / name))


def test_equals_brute_force_with_small_blocks(spark):
    """Clusters, equal vectors that fill many blocks, zero vectors; every way of cutting gives the exact result."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3, 6))[rng.integers(0, 3, 500)] + rng.normal(size=(500, 6)) * 0.05, np.tile([0.3, 0.1, -0.2, 0.5, 0, 1], (300, 1)), np.zeros((3, 6))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, every=20)
    for block, query_block, group in ((64, 8, 1), (8192, 512, 16)):
        assert sorted(map(tuple, op13.nearest(df, every=20, pivots=6, block=block, query_block=query_block, group=group).collect())) == want


def test_edges(spark, tmp_path):
    v, e = [1.0, 2.0], (None, None, None)
    rows = [(0, v, *e), (1, v, 1, "x", "y"), (2, [0.0, 0.0], *e), (3, None, *e), (4, [], *e), (5, [float("nan"), 1.0], *e), (6, [None, 1.0], *e), (7, [1.0], *e), (None, v, *e),
            (1, v, *e), (100, [-1.0, 0.5], *e), (8, [float("inf"), 1.0], *e), (9, [-0.0004, 0.0], *e), (200, [0.0, 0.0], *e)]
    got = query(spark, rows, tmp_path, "a")
    usable = [(r[0], r[1]) for r in rows if r[0] in (0, 1, 2, 100, 9, 200)]
    usable = [(i, [float(np.float32(c)) for c in x]) for i, x in usable]
    assert sorted(map(tuple, got.collect())) == brute(usable)
    assert query(spark, [], tmp_path, "b").count() == 0
    assert query(spark, [(100, v, *e)], tmp_path, "c").count() == 0
    twice = query(spark, [(100, v, *e), (100, [0.0, 1.0], *e)], tmp_path, "d")
    assert sorted(map(tuple, twice.collect())) == [(100, 1, 100, 2048 * 1024)] * 2


def test_extreme_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4))
    x[0], x[7], x[20], x[100] = [1e308, -1e308, 1.0, 2.0], [1e308, 1e308, 0.0, 0.0], 1e12, [3e9, 1e-300, 0.5, -0.5]
    x[30] = x[0]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = query(spark, [(*r, None, None, None) for r in rows], tmp_path, "a", "double")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold_and_searching_stops():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2000, 8)) * 0.1 + c for c in (4 * np.eye(8))[:4]])
    p = op13.choose(x[::7], 12)
    d = op13.distances(x, p)
    norm = d[:, 0] ** 2
    for i in range(0, 8000, 997):
        true = op13.whole(x) @ op13.whole(x[i])
        assert (op13.upper(d[i], d, norm[i], norm) >= true).all()
    b = op13.Block(SimpleNamespace(row=np.arange(8000).tobytes(), vec=np.arange(8000).tobytes(), x=x.tobytes(), d=d.tobytes()), 8, len(p))
    _, at, seen = op13.search_block(b, 5, b, 10, op13.NONE)
    assert seen < 4000 and at.tolist() == [j for j in np.lexsort((np.arange(8000), -(op13.whole(x) @ op13.whole(x[5])))) if j != 5][:10]
    far = op13.Block(SimpleNamespace(row=np.arange(2000).tobytes(), vec=np.arange(2000).tobytes(), x=x[6000:].tobytes(), d=d[6000:].tobytes()), 8, len(p))
    assert op13.search_block(b, 5, far, 10, float(op13.scores(x[5], x[at])[-1]))[2] == 0
