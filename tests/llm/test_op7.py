from __future__ import annotations

import zlib

import numpy as np

from quarrylens.llm import op7_language_id as op7

DDL = "doc_id long, text string, lang string, source string, score string"


def test_windows_cover_every_byte_group():
    for n in (0, 1, 3, 4, 511, 512, 513, 1021, 1022, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        w, sizes = op7.windows(text)
        seen = {w[i, k : k + 4].tobytes() for i in range(len(w)) for k in range(op7.WINDOW - 3)}
        assert all(text[k : k + 4] in seen for k in range(n - 3)) and sizes.max(initial=0) <= op7.WINDOW


def test_lookup_equals_the_plain_convolution():
    net = op7.ByteNet.start(["a", "b"], np.random.default_rng(2))
    x = np.random.default_rng(3).integers(0, 255, (3, op7.WINDOW), dtype=np.uint8)
    e = net.emb[x]
    plain = np.stack([sum(e[:, p + j] @ net.conv[j] for j in range(4)) for p in range(op7.WINDOW - 3)], 1).max(axis=1)
    z = np.maximum(plain + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probs(x, net.pair_tables()), want, atol=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in op7.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [(d.lang, got[d.doc_id]) for d in rows if got[d.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert np.mean([lang == r.lang_pred for lang, r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", None, None), (3, "12 !?", None, None, None), (4, "abc", None, None, None), (4, "abc", None, None, None), (None, "abc " * 50000, "en", None, None)]
    df = spark.createDataFrame(rows, DDL)
    assert {r.lang_pred for r in op7.identify(df.filter("doc_id is null or lang is null")).collect()} == {"und"}
    one = op7.identify(df.unionByName(spark.createDataFrame([(i, "some words", "xx", None, None) for i in range(9)], DDL))).collect()
    assert [r.lang_pred for r in one[:3]] == ["und"] * 3 and one[4].lang_pred == "xx" and len(one) == 15
    assert op7.identify(df.limit(0)).count() == 0
