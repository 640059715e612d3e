from __future__ import annotations

import numpy as np

from quarrylens.llm import op2_additive_ann as op2

DDL = "vec_id long, embedding array<float>, label int, score string"


def brute(ids, x, k=20, every=20):
    out = {}
    for i, own in enumerate(ids):
        if own % every == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out[int(own)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hit = total = 0
    for q, rows in want.items():
        mine = {r.vec_id for r in got if r.query_id == q}
        hit, total = hit + len(mine & {v for v, _ in rows}), total + len(rows)
    return hit / total


def test_beam_beats_greedy_and_tables_equal_decoding():
    x = np.random.default_rng(0).normal(size=(1500, 16)).astype(np.float32)
    books = op2.train(x, stages=4, words=16, rounds=1)
    err = [((x - books.decode(books.encode(x, beam)))**2).sum() for beam in (1, 8)]
    assert err[1] < err[0]
    codes, lut = books.encode(x[:5]), books.tables(x[5:8])
    s = sum(lut[j][codes[:, j]] for j in range(4))
    assert np.allclose(s, books.decode(codes) @ x[5:8].T, atol=1e-3)


def test_top_breaks_ties_by_row():
    assert op2.top(np.array([1.0, 5, 3, 3, 3]), 3).tolist() == [1, 2, 3]


def test_recall_and_order(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    pdf = df.toPandas()
    got = op2.nearest(df, code_block=512, query_block=32).collect()
    want = brute(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(np.float64))
    assert recall(got, want) >= 0.95
    for q in want:
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_edges(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1, None), (1, v, 1, None), (2, v, None, None), (3, None, 1, None), (4, [0.0, 0.0], 1, None), (5, [float("nan"), 1.0], 1, None),
            (6, [None, 1.0], 1, None), (7, [1.0], 1, None), (None, v, 1, None), (1, v, 1, None), (20, [-1.0, 0.5], 1, None), (8, [float("inf"), 1.0], 1, None)]
    got = op2.nearest(spark.createDataFrame(rows, DDL)).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got) if r.query_id == 0] == [(1, 1, 5.0), (2, 1, 5.0), (3, 2, 5.0), (4, 20, 0.0)]
    assert [r.vec_id for r in sorted(got) if r.query_id == 20] == [0, 1, 1, 2]
    assert op2.nearest(spark.createDataFrame([], DDL)).count() == 0
    same = spark.createDataFrame([(i, v, 0, None) for i in range(700)], DDL)
    first = [r.vec_id for r in sorted(op2.nearest(same, code_block=64).collect()) if r.query_id == 0]
    assert first == list(range(1, 21))


def test_extreme_finite_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[0] = 3e38
    x[20] *= 1e-200
    x[7] = 1e-200
    x[8] = 1e150
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = op2.nearest(df, code_block=64).collect()
    assert sorted({r.query_id for r in got}) == list(range(0, 400, 20)) and len(got) == 20 * 20
    assert recall(got, brute(np.arange(400), x)) >= 0.9
    few = spark.createDataFrame([(0, [3e38, 3e38]), *[(i, [float(i), 1.0]) for i in range(1, 30)]], DDL.split(", label")[0])
    assert [r.vec_id for r in sorted(op2.nearest(few).collect()) if r.query_id == 0] == list(range(29, 9, -1))


def test_rows_of_one_vec_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 3.0])]
    got = sorted(map(tuple, op2.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == [(20, 1, 3, 2.0), (20, 1, 3, 3.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]


def test_no_near_row_is_missed_where_codes_fit_badly(spark):
    rng = np.random.default_rng(4)
    even, tied = rng.normal(size=(4000, 256)), rng.integers(0, 2, size=(4000, 16)).astype(float)
    tied[:, 0] = 1  # few different scores: the smaller vec_id decides
    for x in (even, tied):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        want = brute(np.arange(len(x)), x)
        mine = {}
        for r in sorted(op2.nearest(df, every=200, code_block=1024).collect()):
            mine.setdefault(r.query_id, []).append(r.vec_id)
        assert mine == {q: [v for v, _ in rows] for q, rows in want.items() if q % 200 == 0}
