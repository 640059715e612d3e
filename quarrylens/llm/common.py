"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LIBC = ctypes.CDLL(None)
#: A word is a run of bytes other than these six; the regular expression is the same set.
BLANKS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Python step holds at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `most` bytes together; a longer text comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start, base = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    trim()


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """Lower the session's Arrow batches to `rows` rows: texts are long, and Spark counts batches by rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def trim() -> None:
    """Hand freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def parts_of(df: DataFrame) -> int:
    """Shuffle partitions as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def renamed(docs: DataFrame, *known: str) -> DataFrame:
    """The documents with every column but the known ones under a name of its own, so that no name clashes or needs quotes."""
    return docs.toDF(*[c if c in known else f"other_{i}" for i, c in enumerate(docs.columns)])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows written once to the session's checkpoint folder, which all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="quarrylens-ckpt-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
