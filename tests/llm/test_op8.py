from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quarrylens.llm import op8_debruijn_dedup as op8
from quarrylens.llm import repeats

DDL = "doc_id long, text string, lang string, source string, n_chars long, d string, paths string"


def brute(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        w = (text or "").encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    for doc, text in order:
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] != doc:
                gone[i : i + 13] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"v{i}" for i in range(60)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [say(rnd.randint(14, 70)) for _ in range(8)]
    rows = []
    for _ in range(80):
        words = say(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            words += p[a : a + rnd.randint(10, 60)] + say(rnd.randint(0, 9))
        rows.append((rnd.randint(0, 300), rnd.choice((" ", "  ", "\n")).join(words)))
    return rows + [rows[0], (400, rows[1][1]), (401, "a b c " * 40), (402, "a b c " * 30), (403, "same " * 100)]


def got(df):
    return sorted([tuple(r)[:4] for r in op8.digest(df).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)) == brute(rows)


def test_hot_grams_and_small_chunks(spark, monkeypatch):
    rows = corpus(3) + [(None, "no id " * 20 + f"x{i}") for i in range(60)] + [(700 + i, "a licence line that stands in very many documents of the corpus word for word as it is") for i in range(40)]
    monkeypatch.setattr(repeats, "HOT_SHARE", 2)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats.chunks_of, "__defaults__", (700,))
    monkeypatch.setattr(repeats.Contexts.__init__, "__defaults__", (3,))
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert len(repeats.profile(df, op8.SHAPE, 1000, 1)[0]) > 10
    assert got(df) == brute(rows)


def test_equal_hashes_of_different_windows():
    rows = corpus(5)
    data, starts = repeats.join_texts([t.encode() for _, t in rows])
    lo, hi, first = repeats.words(data, starts)
    at = np.flatnonzero(op8.inside_texts(first, 13))
    number, head = op8.edge_numbers(data, lo, hi, at, 13, np.zeros(len(at), np.uint64))
    text = [tuple(data[lo[x] : hi[x]].tobytes() for x in range(a, a + 13)) for a in at.tolist()]
    assert len(set(text)) == len(head) and all(text[i] == text[head[k]] for i, k in enumerate(number.tolist()))


def test_unbranched_paths():
    # a -> b -> c -> d, c -> e, a ring x -> y -> z -> x, and p -> q -> r where q belongs to another bucket
    names = "abcdexyzpqr"
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("y", "z"), ("z", "x"), ("x", "y"), ("p", "q"), ("q", "r")]
    left, right = (np.array([names.index(e[k]) for e in edges]) for k in (0, 1))
    own = np.array([n != "q" for n in names])
    path, step = op8.unbranched(left, right, own)
    assert path.tolist() == [0, 0, 2, 3, 4, 4, 4, 7, 8] and step.tolist() == [0, 1, 0, 0, 0, 1, 2, 0, 0]


def test_paths_name_their_sources(spark):
    p = [f"p{i}" for i in range(200)]
    rows = [(1, " ".join(["x"] * 3 + p)), (2, " ".join(["y"] * 5 + p[20:150] + ["z"])), (3, " ".join(p[:40] + ["q"] + p[41:90]))]
    paths = sorted(map(tuple, op8.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert paths == [(2, 5, 130, 1, 23), (3, 0, 40, 1, 3), (3, 41, 49, 1, 44)]


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, "one two"), (3, "word " * 20000), (4, " ".join(map(str, range(13)))), (5, "\t".join(map(str, range(13)))), (None, "z " * 13), (6, "z " * 14)]
    df = spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in rows], DDL)
    assert got(df) == brute(rows)
    assert op8.digest(df.limit(0)).count() == 0
