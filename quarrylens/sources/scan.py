"""Source trees as rows: discovery, languages, exclusion, reading."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import names as N
from ..functions import scalars as S

MARKERS = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", ".git")


def find_workspace_root(path: str) -> str:
    """The nearest folder above that holds a project marker, else the path as given."""
    at = os.path.abspath(path)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in MARKERS):
            return at
        up = os.path.dirname(at)
        if up == at:
            return path
        at = up


def _list(root: str) -> list[tuple[str, str, int, int]]:
    """(path, path below root, length, mtime) of every file; names only, no file is opened.

    Spark's own file listing leaves out names that start with `_`, and so every package's `__init__.py`.
    """
    if "://" in root:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        infos = store.get_file_info(fs.FileSelector(base, recursive=True))
        scheme = root.split("://")[0]
        return [(f"{scheme}://{i.path}", os.path.relpath(i.path, base), i.size, int(i.mtime_ns // 10**9)) for i in infos if i.type == fs.FileType.File]
    base = os.path.realpath(root.removeprefix("file:"))
    if not os.path.exists(base):
        raise AnalysisError(f"Cannot access path: {root}")
    out, seen = [], set()
    for at, dirs, names in os.walk(base, followlinks=True):
        real = os.path.realpath(at)
        if real in seen:  # a link that leads back
            dirs.clear()
            continue
        seen.add(real)
        for n in names:
            path = os.path.join(at, n)
            try:
                st = os.stat(path)
            except OSError:  # gone or unreadable: left out
                continue
            out.append((path, os.path.relpath(path, base), st.st_size, int(st.st_mtime)))
    return out


LISTING = "path string, rel_path string, length long, mtime long"


def discover(spark: SparkSession, root: str, exclude: Iterable[str] = N.DEFAULT_EXCLUDE) -> DataFrame:
    """path, rel_path, language, length, mtime of all source files below root that no pattern excludes."""
    rows = spark.createDataFrame(_list(root), LISTING).withColumn("language", S.language("rel_path"))
    return rows.filter(F.col("language").isNotNull() & ~S.excluded("rel_path", tuple(exclude)))


def by_path(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Sorted by the parts of the path."""
    return df.orderBy(F.split(path, "/"))


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def _open(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):  # one file at a time: sizes differ widely
            one = b.slice(i, 1)
            data, error = None, None
            try:
                data = _open(one.column("path")[0].as_py())
            except OSError as e:
                error = str(e)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary()), pa.array([error], pa.string())], [*one.schema.names, "bytes", "failed"])


def read(files: DataFrame) -> DataFrame:
    """Text and digest of each file; files that cannot be read or are not UTF-8 keep a row with an error."""
    cols = ["path", "rel_path", "language", "length", "mtime"]
    spread = files.select(cols).repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    got = spread.mapInArrow(_contents, LISTING.replace("length", "language string, length") + ", bytes binary, failed string")
    text = F.col("bytes").cast("string")
    ok = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    return got.select(
        *cols, F.when(ok, text).alias("content"), F.sha2("bytes", 256).alias("content_hash"),
        F.coalesce("failed", F.when(~ok, "stream did not contain valid UTF-8")).alias("error"))
