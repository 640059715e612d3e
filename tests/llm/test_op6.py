from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from quarrylens.llm import op6_suffix_dedup as op6
from quarrylens.llm import repeats

DDL = "doc_id long, text string, lang string, source string, n_chars long, d string, spans string"


def brute(rows):
    """rows: (doc_id, text); the result by row, in the order of (doc_id, hash of the text)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64))):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        edges = np.diff(gone.astype(int), prepend=0)
        out.append((doc, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß ") for _ in range(rnd.randint(1, 9)))
    passage = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passage)
            a = rnd.randint(0, len(p) // 2)
            parts.insert(rnd.randint(0, 3), p[a : a + rnd.randint(50, 400)])
        rows.append((rnd.randint(0, 500), " ".join(parts)))
    return rows + [rows[0], rows[1], (600, rows[2][1]), (601, "ab" * 300), (602, "x" * 350), (603, "the same. " * 40)]


def test_multikey_sort_is_a_sort():
    t = np.random.default_rng(0).integers(0, 3, (500, 6)).astype(np.uint64)
    order, shared = op6.multikey_sort(t)
    rows = [tuple(x) for x in t[order]]
    assert rows == sorted(rows)
    want = [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(rows, rows[1:])]
    assert shared[1:].tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert sorted(map(tuple, op6.digest(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("leads", [200_000, 3])
def test_hot_grams_and_few_splitters(spark, monkeypatch, leads):
    rows = corpus(3) + [(700 + i, f"licence {i} " + "all rights are reserved and nobody may copy this text without the written consent of its owner. " * 2) for i in range(40)]
    monkeypatch.setattr(repeats, "HOT_SHARE", 2)
    monkeypatch.setattr(repeats, "LEADS_MOST", leads)
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert len(repeats.profile(df, op6.SHAPE, 1000, 1)[0]) > 10
    assert sorted(map(tuple, op6.digest(df).collect()), key=str) == brute(rows)


def test_small_chunks_and_forgetful_tasks(spark, monkeypatch):
    rows = corpus(4) + [(None, "no id " * 40 + str(i)) for i in range(60)] + [(5, "one id " * 40 + str(i)) for i in range(60)]
    for name, value in (("CHUNK", 700), ("SEEN_SLOTS", 4)):
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(repeats.chunks_of, "__defaults__", (700,))
    monkeypatch.setattr(repeats.Contexts.__init__, "__defaults__", (3,))
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert sorted(map(tuple, op6.digest(df).collect()), key=str) == brute(rows)


def test_chunks_depend_on_the_rows_only():
    import pyarrow as pa

    texts = ["a" * n for n in (3, 0, 9, 30, 0, 2, 2, 2, 8, 1, 0, 0, 10, 10)]
    gids = [1] * 9 + [4] * 5
    whole = pa.RecordBatch.from_pydict({"gid": gids, "text": texts})
    cut = lambda k: [(c.gid, c.sub, [len(x) for x in c.texts()]) for c in repeats.chunks_of(iter([whole.slice(i, k) for i in range(0, 14, k)]), 10)]
    assert cut(14) == cut(1) == cut(3) == cut(5)
    assert sum(len(x[2]) for x in cut(14)) == 14 and all(sum(x[2]) <= 10 or len(x[2]) == 1 for x in cut(14))


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, "short"), (3, "word " * 20000), (4, "é" * 120), (5, "é" * 119 + "x"), (None, "z" * 120), (6, "z" * 120)]
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert sorted(map(tuple, op6.digest(df).collect()), key=str) == brute(rows)
    assert op6.digest(df.limit(0)).count() == 0
    kept = op6.clean(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got[2] == "short" and got[1] == "" and 6 not in got and got[5].endswith("x") and "�" not in got[5]
