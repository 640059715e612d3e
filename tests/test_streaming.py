from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.streaming import state as T

DDL = "path string, ts timestamp, seq long, event string"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"f{i % 5}", i, "did_close" if i % 7 == 0 else "did_open") for i in range(40)]
    df = spark.createDataFrame([(p, s, e) for p, s, e in rows], "path string, seq long, event string").withColumn("ts", F.timestamp_seconds("seq")).select("path", "ts", "seq", "event")
    seen = []
    for k in range(4):
        df.filter(F.col("seq").between(10 * k, 10 * k + 9)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 2).parquet(src)
        T.follow_open_state(stream, str(tmp_path / "state"), str(tmp_path / "ck"), lambda s: seen.append(s.count())).awaitTermination(120)
    last = T._snapshot(spark, str(tmp_path / "state"), 1000)
    want = {(r.path, r.event, r.is_open) for r in T.open_state(df).collect()}
    assert {(r.path, r.event, r.is_open) for r in last.collect()} == want and seen[-1] == 5


def test_windows(spark):
    df = spark.createDataFrame([(1, "a"), (5, "a"), (70, "b")], "s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.k, r.changes) for r in T.change_rate(df, "ts", "k", "1 minute").collect()) == [("a", 2), ("b", 1)]


def test_saved_files_are_analysed_again(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    seen = []

    def analyse(df):
        seen.append({r.path.rsplit("/", 1)[1]: bytes(r.content) for r in df.collect()})

    def once():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src))
        T.reanalyse_on_save(files, analyse, str(tmp_path / "ck")).awaitTermination(120)

    once()
    (src / "b.py").write_text("y = 2\n")
    once()
    assert seen == [{"a.py": b"x = 1\n"}, {"b.py": b"y = 2\n"}]
