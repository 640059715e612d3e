from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from quarrylens.llm.op10_sharding import SHARDS, place, shard

DDL = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def test_place_balances_all_three():
    rng = np.random.default_rng(1)
    items = np.column_stack([rng.lognormal(6, 1, 3000), rng.lognormal(4, 1, 3000), np.ones(3000)])
    cap = np.tile(items.sum(axis=0) / 8, (8, 1))
    out = place(items, cap.copy())
    for d in range(3):
        got = np.bincount(out, items[:, d], 8)
        assert np.ptp(got) / got.mean() < 0.05


def facts(rows, together=True):
    slots, size, shards_of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < SHARDS and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        shards_of[(r.text_crc32, r["size"])].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, shards_of


def test_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = shard(docs).collect()
    size, shards_of = facts(a)
    assert len(a) == docs.count() and max(map(len, shards_of.values())) == 1
    assert max(size.values()) - min(size.values()) < 0.05 * np.mean(list(size.values()))
    assert sorted(map(tuple, shard(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, a), key=str)


def test_edges_and_hot_group(spark):
    rows = [(i, "same text here", None, None, None, "x") for i in range(2000)] + [(i, f"text {i} " * (i % 7), None, None, None, "x") for i in range(2000, 6000)]
    rows += [(None, None, None, None, None, None), (7, "", None, None, None, None), (9008, "long " * 200, None, None, None, None)]
    got = shard(spark.createDataFrame(rows, DDL)).collect()
    size, _ = facts(got)
    assert len(got) == len(rows) and max(size.values()) - min(size.values()) < 0.06 * np.mean(list(size.values()))
    r = next(r for r in got if r.doc_id == 9008)
    assert r["size"] == 1008 and r.text_crc32 == zlib.crc32(b"long " * 200)
    assert shard(spark.createDataFrame([], DDL)).count() == 0


def test_hot_text_without_doc_ids_or_with_one(spark):
    rows = [(None, "same text here " * 10, None, None, None, "x")] * 3000 + [(4, "another text " * 10, None, None, None, "x")] * 3000
    rows += [(i, f"text {i}", None, None, None, "x") for i in range(1000)]
    got = shard(spark.createDataFrame(rows, DDL)).collect()
    size, _ = facts(got)
    assert len(got) == 7000 and max(size.values()) - min(size.values()) < 0.1 * np.mean(list(size.values()))
