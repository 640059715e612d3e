from __future__ import annotations

import random

import pytest

from quarrylens.operators import graph as G
from quarrylens.operators import reach as R


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    out = {}
    for n in nodes:
        comp = {m for m in reach[n] if n in reach[m]}
        if len(comp) > 1:
            out[n] = min(comp)
    return out


def test_depths(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3)])
    start = spark.createDataFrame([(0,)], "file_id long")
    for d in (1, 2, 3):
        assert {r.file_id for r in R.transitive_imports(e, start, d).collect()} == set(range(1, d + 1))
    ring = frame(spark, [(0, 1), (1, 2), (2, 0)])
    assert {r.file_id for r in R.transitive_imports(ring, start, 9).collect()} == {1, 2}


def test_components_equal_plain_reachability(spark):
    rnd = random.Random(3)
    for n in (6, 14):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n + n // 3)]
        got = {r.file_id: r.component for r in G.strong_components(frame(spark, pairs)).collect()}
        assert got == plain_components(pairs)
    assert G.strong_components(frame(spark, [(0, 1), (1, 2)])).count() == 0 and G.strong_components(frame(spark, [])).count() == 0


def test_cycles_are_canonical(spark):
    pairs = [(3, 1), (1, 2), (2, 3), (2, 3), (5, 6), (6, 5), (6, 7), (7, 7)]
    assert sorted(r.cycle for r in G.cycles(frame(spark, pairs)).collect()) == [[1, 2, 3], [5, 6]]


def plain_cycles(pairs):
    """The definition read aloud: breadth-first trees of each component, paths by following parents."""
    comp = plain_components(pairs)
    inner = sorted({(a, b) for a, b in pairs if a != b and comp.get(a) is not None and comp.get(a) == comp.get(b)})
    out = set()
    for root in set(comp.values()):
        own = [(a, b) for a, b in inner if comp[a] == root]

        def tree(own, root=root):
            parent, level = {root: None}, [root]
            while level:
                new = {}
                for a in sorted(level):
                    for x, b in own:
                        if x == a and b not in parent:
                            new.setdefault(b, a)
                parent |= new
                level = list(new)
            return parent

        down, up = tree(own), tree([(b, a) for a, b in own])

        def way(parent, x):
            return [x, *way(parent, parent[x])] if parent[x] is not None else [x]

        for a, b in own:
            back, there = way(up, b), way(down, a)[::-1]
            x = next(v for v in back if v in there)
            ring = back[: back.index(x)] + there[there.index(x) :]
            k = ring.index(min(ring))
            out.add((root, tuple(ring[k:] + ring[:k])))
    return sorted(out)


def chain(ids):
    return list(zip(ids, ids[1:], strict=False))


@pytest.mark.parametrize("seed", (3,))
def test_cycles_equal_plain_ones(spark, seed):
    """Random graphs with long chains, parallel chains, loops through one file and rings of their own."""
    rnd = random.Random(seed)
    n = 9 + 3 * seed
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n + seed)]
    for k in range(4):
        a, b = rnd.randrange(n), rnd.randrange(n)
        pairs += chain([a, *rnd.sample(range(100 * k + 100, 100 * k + 190), rnd.randrange(1, 9)), b])
    pairs += chain([700, 705, 703, 700]) + chain([3, 800, 2]) + chain([3, 801, 2]) + [(600, 600)]
    got = G.cycles(frame(spark, pairs)).collect()
    assert sorted((r.component, tuple(r.cycle)) for r in got) == plain_cycles(pairs)


def test_many_components_and_pivots(spark, monkeypatch):
    """More components than pivots: the rest is coloured."""
    monkeypatch.setattr(R, "LANES", 2)
    monkeypatch.setattr(R, "WORDS", 1)
    monkeypatch.setattr(R, "WORD_COLUMNS", ["w0"])
    monkeypatch.setattr(R, "_W", ["w0"])
    rnd = random.Random(8)
    pairs = [(10 * c + rnd.randrange(5), 10 * c + rnd.randrange(5)) for c in range(12) for _ in range(9)] + [(10 * c, 10 * c + 13) for c in range(11)]
    assert {r.file_id: r.component for r in G.strong_components(frame(spark, pairs)).collect()} == plain_components(pairs)


def test_ring_of_100000_files_takes_few_rounds(spark, monkeypatch):
    from quarrylens.operators import rings

    cuts = []
    monkeypatch.setattr(rings, "written", lambda df, real=rings.written: cuts.append(1) or real(df))
    n = 100_000
    ids = spark.range(n).selectExpr("(id * 7919) % 100000 as src", "((id + 1) * 7919) % 100000 as dst")
    rows = G.cycles(ids).collect()
    assert len(cuts) < 130 and len(rows) == 1 and rows[0].cycle == [i * 7919 % n for i in range(n)]


def test_empty_graph(spark):
    assert G.cycles(frame(spark, [])).count() == 0 and G.cycles(frame(spark, [(1, 2), (2, 3), (2, 2)])).count() == 0


@pytest.mark.parametrize("held,steps,batch", ((7, 3, "5"), (10**6, 64, "10000")))
def test_near_files_are_put_together_first(spark, monkeypatch, held, steps, batch):
    """Groups of neighbouring ids: tasks put them together in pieces of HELD edges, files whose edges are cut over pieces too; few edges are left."""
    from quarrylens.operators import rings

    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(rings, "STEPS", steps)
    rnd = random.Random(4)
    pairs = [(100 * c + rnd.randrange(8), 100 * c + rnd.randrange(8)) for c in range(5) for _ in range(24)] + [(100 * c, 100 * c + 100) for c in range(4)] + [(300, 207), (400, 301), (-4, 3), (3, -4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        group, left = rings._shrunk(rings._plain(frame(spark, pairs)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, comp = group.collect(), plain_components(pairs)
    of = {r.v: r.c for r in rows}
    assert len(of) == len(rows) and all(comp[v] == comp[c] for v, c in of.items())
    want = {(of.get(a, a), of.get(b, b)) for a, b in pairs}
    assert sorted(map(tuple, left.collect())) == sorted(x for x in want if x[0] != x[1]) and left.count() < len(pairs) / 3
