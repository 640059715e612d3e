from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quarrylens.llm import op5_jaccard_join as op5
from quarrylens.llm.components import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, class_id string"


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(ids, texts, threshold=0.8):
    sets, n = brute_sets(texts), len(ids)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j), key=lambda k: ids[k])] = min(find(i), find(j), key=lambda k: ids[k])
    return {ids[i]: (min(ids[k] for k in range(n) if find(k) == find(i)), links[i]) for i in range(n)}


def near_texts(n, seed=0):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(6, 90))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
    return out


def test_banding_reaches_the_target():
    b = op5.choose_banding()
    assert b.recall(0.8) >= 0.9998 and b.recall(0.3) <= 0.02


def test_counts_equal_brute_force():
    texts = near_texts(60) + ["shared line " * 30 + f"x{i}" for i in range(40)]
    g, s = op5.shingle_sets([t.encode() for t in texts])
    sets = [g[a:b] for a, b in zip(s, s[1:])]
    want = brute_sets(texts)
    assert [len(x) for x in sets] == [len(x) for x in want]
    got = op5.common_counts(sets)
    assert got.tolist() == [[len(a & b) for b in want] for a in want]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def run(spark, ids, texts, **kw):
    df = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in zip(ids, texts, strict=True)], DDL)
    return {r.doc_id: (r.class_id, r.n_links) for r in op5.near_duplicates(df, **kw).collect()}


def test_equals_brute_force_also_over_blocks(spark):
    texts = near_texts(160)
    ids = random.Random(1).sample(range(1000), 160)
    want = brute(ids, texts)
    assert run(spark, ids, texts) == want
    assert run(spark, ids, texts, block_docs=3) == want


def test_edges(spark):
    ids, texts = [5, 2, 9, 4, 7, 8], [None, "", "a b", "a b", "  ", "long " * 30000]
    assert run(spark, ids, texts) == {5: (2, 2), 2: (2, 2), 7: (2, 2), 9: (4, 1), 4: (4, 1), 8: (8, 0)}
    df = spark.createDataFrame([(None, "a b c", None, None, None, None), (1, "a b c", None, None, None, None), (1, "a b c", None, None, None, None)], DDL)
    got = sorted(op5.near_duplicates(df).collect(), key=lambda r: (r.doc_id is not None, r))
    assert [(r.doc_id, r.class_id, r.n_links) for r in got] == [(None, None, 0), (1, 1, 1), (1, 1, 1)]
    assert op5.near_duplicates(df.limit(0)).count() == 0
    assert np.isclose(op5.Banding(3, 2).recall(0.5), 1 - 0.75**3)


def test_rows_of_one_doc_id_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], DDL).repartition(3)
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in op5.near_duplicates(df).collect())
        assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
        kept = sorted((r.doc_id, r.text) for r in op5.keep_one(df).collect())
        assert kept == [(1, a), (1, b)]


def test_keep_one_hands_on_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (None, "a b", 7, 8, 9)], "doc_id long, text string, __head int, key int, `a.b` int")
    got = op5.keep_one(df)
    assert got.columns == df.columns and sorted(r["a.b"] for r in got.collect()) == [3, 9]


def test_negative_ids_and_least_id_first(spark):
    assert run(spark, [-5, 3, -(1 << 63), (1 << 63) - 1], ["q w e r t y"] * 4) == {i: (-(1 << 63), 3) for i in (-5, 3, -(1 << 63), (1 << 63) - 1)}


def test_hot_keys_are_spread(spark):
    from quarrylens.llm.components import spread_join

    many = spark.range(5000).selectExpr("case when id < 4000 then 0 else id end as k", "id as v")
    one = many.groupBy("k").count().selectExpr("k", "count as n")
    assert sorted(r.v for r in spread_join(many, one, "k", "n", 5000).collect()) == list(range(5000))
    hub = spark.createDataFrame([(0, i) for i in range(1, 3000)], "a long, b long")
    assert {r.root for r in components(hub).collect()} == {0}


def test_links_do_not_depend_on_group_sizes(spark):
    """A weak banding, so that many pairs above the threshold share no band: whole groups and blocks still agree."""
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[i : i + 60]) for i in range(40)]
    texts = chain + near_texts(40, seed=5)
    ids = list(range(len(texts)))
    whole = run(spark, ids, texts, recall=0.5, block_docs=10**9)
    assert run(spark, ids, texts, recall=0.5, block_docs=2) == whole
    assert sum(n for _, n in whole.values()) < sum(n for _, n in brute(ids, texts).values())


def test_keep_one_is_the_same_under_any_partitioning(spark):
    rows = [(i % 4, "a b c d e f " + "x " * (i % 2), i, None if i % 3 else f"t{i}") for i in range(200)]
    kept = set()
    for n in (1, 3, 7):
        random.Random(n).shuffle(rows)
        kept.add(tuple(sorted(map(tuple, op5.keep_one(spark.createDataFrame(rows, "doc_id long, text string, tag int, other string").repartition(n)).collect()))))
    assert len(kept) == 1


def test_many_near_copies_are_not_sent_for_every_band(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if j != k else f"x{i}" for j, w in enumerate(base)) for i, k in enumerate(rng.integers(0, 300, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sk = op5.sketches(docs, op5.choose_banding()).withColumnRenamed("key", "rep").withColumn("copies", F.lit(1).cast("long"))
    members = op5._members(sk, 8, 1_000_000)
    assert members.select(F.explode("dest.blocks").alias("b")).agg(F.sum("b")).first()[0] <= 60 * 8
    whole, cut = (sorted(map(tuple, op5.near_duplicates(docs, block_docs=n).collect())) for n in (1024, 8))
    assert whole == cut and {r[2] for r in cut} == {0}
