"""Open files and changes, as batch plans and as streams over the same functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def open_state(events: DataFrame, close: str = "did_close") -> DataFrame:
    """Latest event of each path (path, ts, seq, event): it is open unless that event closes it. Combines map-side."""
    last = events.groupBy("path").agg(F.max_by("event", F.struct("ts", "seq")).alias("event"))
    return last.withColumn("is_open", F.col("event") != close)


def change_rate(events: DataFrame, ts: str, by: str, window: str, watermark: str | None = None) -> DataFrame:
    """Events in tumbling windows; on a stream, late ones count until the watermark passes."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("changes"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "changes")


def follow_open_state(events: DataFrame, table_path: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None, close: str = "did_close") -> StreamingQuery:
    """Keep the open state in a folder of snapshots, one for each micro-batch that brought events.

    A batch's latest events are merged with the newest snapshot; each snapshot is written under its batch id, so a
    batch that is run again writes the same rows to the same place.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("path", "ts", "seq", "event")
        prior = _snapshot(spark, table_path, batch_id)
        if prior is not None:
            rows = rows.unionByName(prior.select("path", "ts", "seq", "event"))
        best = F.max(F.struct("ts", "seq", "event")).alias("m")
        state = rows.groupBy("path").agg(best).select("path", "m.ts", "m.seq", "m.event").withColumn("is_open", F.col("event") != close)
        state.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        if publish is not None:
            publish(spark.read.parquet(f"{table_path}/batch={batch_id}"))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot(spark, table_path: str, before: int) -> DataFrame | None:
    """The newest snapshot of an earlier batch that was written to its end."""
    for k in range(before - 1, -1, -1):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/batch={k}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(f"{table_path}/batch={k}")
    return None


def published_diagnostics(findings: DataFrame, open_files: DataFrame) -> DataFrame:
    """One row for each open file: path and its findings in the order of their lines; files without any get an empty list.

    findings: path, severity, code, line, message, related; each message goes out whole and replaces the one before.
    """
    item = F.struct("line", "code", "severity", "message", "related")
    some = findings.filter("code is not null").groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("diagnostics"))
    out = open_files.select("path").distinct().join(some, "path", "left")
    return out.select("path", F.coalesce(F.size("diagnostics"), F.lit(0)).alias("count"), F.coalesce(F.to_json("diagnostics"), F.lit("[]")).alias("diagnostics"))


def newest_events(events: DataFrame, close: str = "did_close", watermark: str = "1 hour") -> DataFrame:
    """From a stream of (path, ts, seq, event): of each path the newest event of a batch, if none newer was seen before; with is_open.

    State is one (ts, seq) a path, so repeated events and those that come late give nothing. A closed path's state goes when the
    watermark has passed its close, as older events no longer arrive then; an open path keeps its state.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else None
        best = None
        for pdf in frames:
            for us, seq, event in pdf[["us", "seq", "event"]].itertuples(index=False):
                if (last is None or (us, seq) > last[:2]) and (best is None or (us, seq) > best[:2]):
                    best = int(us), int(seq), event
        if best:
            last = (*best[:2], best[2] != close)
            state.update(last)
            yield pd.DataFrame({"path": [key[0]], "us": [best[0]], "seq": [best[1]], "event": [best[2]], "is_open": [last[2]]})
        if last and not last[2]:  # each call takes the timeout off
            state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + 1)

    rows = events.select("path", "ts", F.unix_micros("ts").alias("us"), "seq", "event").filter("path is not null and ts is not null and seq is not null").withWatermark("ts", watermark)
    out = rows.groupBy("path").applyInPandasWithState(step, "path string, us long, seq long, event string, is_open boolean", "us long, seq long, is_open boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("path", F.timestamp_micros("us").alias("ts"), "seq", "event", "is_open")


def publications(newest: DataFrame, findings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, ts, seq, count, diagnostics for each newest event: an open path's findings, an empty list when it was closed."""
    sent = published_diagnostics(findings(newest.filter("is_open").select("path")), newest)
    out = newest.select("path", "ts", "seq", "is_open").join(sent, "path")
    return out.select("path", "ts", "seq", F.when(F.col("is_open"), F.col("count")).otherwise(0).alias("count"), F.when(F.col("is_open"), F.col("diagnostics")).otherwise("[]").alias("diagnostics"))


def publish_stream(events: DataFrame, findings: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, close: str = "did_close", watermark: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Publish on every open, change and close: one message a path and micro-batch, under the batch's number.

    findings: gives the findings of a table of paths, of the read model as it is at that time. A batch that is run again writes
    the same messages to the same place. `published` reads what is valid.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for open paths and for all
        publications(batch, findings).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    query = newest_events(events, close, watermark).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def published(sink: DataFrame) -> DataFrame:
    """The last message of each path: path, count, diagnostics. sink: all messages."""
    return sink.groupBy("path").agg(F.max_by(F.struct("count", "diagnostics"), F.struct("ts", "seq")).alias("m")).select("path", "m.*")


def reanalyse_on_save(files: DataFrame, analyse: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand the files of each micro-batch (a binaryFile stream) to `analyse`, newest version of a path only."""

    def step(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"), F.max("modificationTime").alias("modificationTime"), F.max_by("length", "modificationTime").alias("length"))
        analyse(newest)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
