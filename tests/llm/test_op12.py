from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest

from quarrylens.llm import op12_prefix_trie as op12

DDL = "conv_id long, turn long, role string, text string, key string, part string"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for c in own:
        own[c] = [t[1:] for t in sorted(own[c])]
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])  # the remainder has the sign of c, as in SQL
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if new[c] == p)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, df, tmp_path, name):
    df.write.mode("overwrite").parquet(str(tmp_path / name / "conversations.parquet"))
    return op12.op12_prefix_trie(spark, str(tmp_path / name))


def some(rnd, n):
    rows = []
    for c in rnd.sample(range(400), n):
        for t in range(rnd.choice([0, 1, 1, 2, 3, 7, 9])):
            rows.append((c, t if rnd.random() > 0.2 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "ä", "bb", "long\n" * 40]), "x", None))
    return rows


# equal turns in one conversation order by digest here and by text there: only one text a turn number
def untied(rows):
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_equals_brute_force(spark, tmp_path, seed):
    rows = untied(some(random.Random(seed), 250))
    rows += [(None, 1, "user", "left out", None, None)] * 2 + [(900, 3, "user", "z" * 30_000, None, None), (-7, 0, None, None, None, None)]
    got = query(spark, spark.createDataFrame(rows, DDL).repartition(5), tmp_path, "a")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_hot_conversation_over_many_ranges(spark, tmp_path, monkeypatch):
    """One conversation has most of the rows: its node spans ranges, and its ids come in pieces."""
    monkeypatch.setattr(op12, "CHUNK", 64)
    rows = [(100 * c + 17, t, "user", f"t{t}", None, None) for c in range(900) for t in range(2)] + untied(some(random.Random(4), 60))
    got = query(spark, spark.createDataFrame(rows, DDL), tmp_path, "b")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_sweeps_of_any_cut_agree():
    """Ranges cut anywhere, also inside runs of equal rows, give the nodes of one range."""
    rnd = random.Random(9)
    turn = lambda i: bytes([i]) * 16 + i.to_bytes(4, "big")
    rows = sorted({(b"".join(turn(rnd.randrange(3)) for _ in range(rnd.randrange(5))), c) for c in range(120)})

    def nodes(cuts):
        import pandas as pd

        found = []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            s = op12.Sweep(part)
            for key, conv in rows[a:b]:
                s.row(key, conv)
            s.close()
            found += s.out
        names = [c.split()[0] for c in op12.FOUND.split(", ")]
        pdf = pd.DataFrame(found, columns=names)
        stitched = op12._stitch(pdf[pdf["kind"] == "open"])
        place = {(p, s, r.depth): r.conv_id for r in stitched.itertuples() for p, s in zip(r.parts, r.sides, strict=True)}
        out = [(r[1], r[2], r[3] if r[9] is None else place[r[9], r[10], r[2] - 1], *r[4:8]) for r in found if r[0] == "node"]
        out += [(r.conv_id, r.depth, None if r.depth == 0 else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in stitched.itertuples()]
        return sorted(tuple(None if v is None else int(v) for v in r) for r in out if r[1]), [tuple(map(int, (*r[:2], *r[3:]))) for r in out if not r[1]]

    whole = nodes([])
    for n in (1, 2, 5, 30, 119):
        assert nodes(sorted(rnd.sample(range(1, len(rows)), n))) == whole


def test_ties_repeats_and_empty(spark, tmp_path):
    assert query(spark, spark.createDataFrame([], DDL), tmp_path, "c").count() == 0
    rows = [(c, None, "user", "same", None, None) for c in (5, 6) for _ in range(8)]
    got = query(spark, spark.createDataFrame(rows, DDL), tmp_path, "d")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    tied = [(c, 1, "user", t, None, None) for c, ts in ((7, "abc"), (8, "cab"), (9, "bca")) for t in ts * 3]
    a, b = (sorted(map(tuple, query(spark, spark.createDataFrame(r, DDL).repartition(3), tmp_path, n).collect()), key=str) for r, n in ((tied, "e"), (tied[::-1], "f")))
    assert a == b
