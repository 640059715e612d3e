"""Signed changes against full analyses; publication on a stream against its batch form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import deltas as D
from quarrylens.streaming import state as T


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def project(rnd, files=30):
    imports = [(rnd.randrange(files), f"m{rnd.randrange(files + 5)}") for _ in range(80)]
    names = [(f"m{i}", i) for i in range(files) if rnd.random() > 0.2]
    return imports, names


@pytest.mark.parametrize("seed", (1,))
def test_state_after_changes_is_the_full_analysis(spark, seed):
    rnd = random.Random(seed)
    homes = spark.createDataFrame([(i, f"h{i % 4}") for i in range(30)], "file_id long, home string")
    tables = lambda p: (spark.createDataFrame(p[0], "src long, module string"), spark.createDataFrame(p[1], "module string, dst long"))
    versions = [tables(project(rnd)) for _ in range(3)] + [tables(([], []))]
    s = D.ImportState(*versions[0], homes)
    for (i0, n0), (i1, n1) in zip(versions, versions[1:], strict=False):
        s = s.after(D.difference(i0, i1), D.difference(n0, n1))
        full = D.ImportState(i1, n1, homes)
        for a, b, columns in ((s.edges, full.edges, ("src", "dst", "sign")), (s.out, full.out, ("src", "n")), (s.into, full.into, ("dst", "n")), (s.between, full.between, ("from_home", "to_home", "n"))):
            assert rows(a, *columns) == rows(b, *columns)
        s = D.ImportState(i1, n1, homes, *[spark.createDataFrame(x.collect(), x.schema) for x in (s.edges, s.out, s.into, s.between)])  # as if written and read


def test_only_changed_keys_are_touched(spark):
    imports = spark.range(1000).selectExpr("id src", "concat('m', id + 1) module")
    names = spark.range(1001).selectExpr("concat('m', id) module", "id dst")
    later = imports.filter("src not in (5, 6)").unionByName(spark.createDataFrame([(5, "m9"), (5, "m9")], "src long, module string"))
    changed = spark.createDataFrame([(5,), (6,)], "src long")
    d = D.of_changed(imports, later, changed, "src")
    assert rows(d, "src", "module", "sign") == [(5, "m6", -1), (5, "m9", 2), (6, "m7", -1)]
    d_edges = D.join(imports, d, names, D.difference(names, names), ["module"])
    d_in = D.sums(d_edges, ["dst"])
    state = D.sums(imports.join(names, "module"), ["dst"])
    assert rows(D.touched(state, d_in, ["dst"]), "dst", "n") == [(6, 0), (7, 0), (9, 3)]
    assert D.upsert(state, D.touched(state, d_in, ["dst"]), ["dst"]).count() == 998
    gone = D.join(imports, D.difference(imports, imports), names, D.difference(names, names.filter("dst <> 3")), ["module"])
    assert rows(gone, "src", "dst", "sign") == [(2, 3, -1)]


def test_sums_of_measures_and_nulls(spark):
    t = spark.createDataFrame([("a", 1), ("a", 4), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 1), (None, 2), (None, 2)], "k string, v int")
    d = D.difference(t, new)
    assert rows(d, "k", "v", "sign") == [("a", 4, -1), (None, 2, 1)]
    assert rows(D.sums(d, ["k"], total=F.col("v")), "k", "n", "total") == [("a", -1, -4), (None, 1, 2)]


def findings(spark, paths):
    """All five codes; one file has two findings on one line, one has none."""
    codes = ["circular-dependency", "missing-module-docs", "missing-class-docs", "high-complexity", "too-many-functions"]
    all_ = [(f"f{i}", "HINT", codes[j], i, f"m{j}", ["x"]) for i in range(5) for j in range(i + 1 if i else 0)]
    found = spark.createDataFrame(all_, "path string, severity string, code string, line int, message string, related array<string>")
    return paths.join(found, "path", "left")


def test_publication_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    events = [(f"f{rnd.randrange(7)}", 10 * i, i, rnd.choice(["did_open", "did_change", "did_close"])) for i in range(60)]
    df = spark.createDataFrame(events, "path string, s long, seq long, event string").select("path", F.timestamp_seconds("s").alias("ts"), "seq", "event")
    ddl = "path string, ts timestamp, seq long, event string"
    order = list(range(60))
    late = sorted(order, key=lambda i: i + rnd.randrange(25))  # events come late, within the watermark
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for k in range(6):
        some = late[10 * k : 10 * k + 10] + late[max(0, 10 * k - 3) : 10 * k]  # the last three again
        df.filter(F.col("seq").isin(some)).coalesce(1).write.mode("append").parquet(src)
        if k == 3:
            spark.createDataFrame([(None, None, 1, "did_open"), ("f1", None, 2, "did_open")], ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        T.publish_stream(stream, lambda p: findings(p.sparkSession, p), sink, ck).awaitTermination(180)
    sent = spark.read.parquet(sink)
    newest = T.open_state(df).join(df.groupBy("path").agg(F.max(F.struct("ts", "seq")).alias("at")), "path").select("path", "at.ts", "at.seq", "event", "is_open")
    want = T.publications(newest, lambda p: findings(spark, p))
    assert rows(T.published(sent), "path", "count", "diagnostics") == rows(want, "path", "count", "diagnostics")
    assert {r.count for r in want.select("count").collect()} != {0} and sent.groupBy("path", "ts", "seq").count().filter("count > 1").count() == 0
    closed = sent.join(df.filter("event = 'did_close'").select("path", "seq"), ["path", "seq"])
    assert closed.count() and closed.filter("count > 0 or diagnostics <> '[]'").count() == 0


def test_closed_paths_leave_no_state(spark, tmp_path):
    """After the watermark has passed a close, an event of that path older than it is dropped, a newer one opens it again."""
    ddl = "path string, ts timestamp, seq long, event string"
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    batches = [[("a", 0, 1, "did_open"), ("a", 10, 2, "did_close")], [("b", 9000, 3, "did_open")], [("b", 9001, 4, "did_change")], [("a", 5, 5, "did_open")], [("a", 9500, 6, "did_open")]]
    for b in batches:
        spark.createDataFrame(b, "path string, s long, seq long, event string").select("path", F.timestamp_seconds("s").alias("ts"), "seq", "event").coalesce(1).write.mode("append").parquet(src)
        T.publish_stream(spark.readStream.schema(ddl).parquet(src), lambda p: findings(p.sparkSession, p), sink, ck).awaitTermination(180)
    assert rows(spark.read.parquet(sink), "path", "seq") == [("a", 2), ("a", 6), ("b", 3), ("b", 4)]
