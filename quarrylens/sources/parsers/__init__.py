"""Parsers: source text to rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from ...schemas import PARSED
from . import braces, model, python_

_BY_LANGUAGE: dict[str, Callable[[str], dict]] = {
    "JavaScript": braces.javascript, "TypeScript": braces.javascript, "Rust": braces.rust, "Go": braces.go, "Java": braces.java, "C": braces.c, "Cpp": braces.cpp,
}


def parse_source(text: str, language: str, compat: bool = False) -> dict:
    """docstring, imports, classes, functions and constants of one source text."""
    return python_.parse(text, compat) if language == "Python" else _BY_LANGUAGE[language](text)


def parse_files(files: DataFrame, compat: bool = False) -> DataFrame:
    """PARSED rows of files (path, rel_path, language, content, error). A file that cannot be read or parsed keeps its
    row, with the reason in `error`. Files are parsed where they lie: one pass over Arrow batches, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(PARSED))
    empty = model.parsed()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                out, error = empty, r["error"]
                if error is None:
                    try:
                        out = parse_source(r["content"], r["language"], compat)
                    except Exception as e:  # one bad file must not end the job: it is reported
                        error = f"{type(e).__name__}: {e}"
                rows.append({"path": r["path"], "rel_path": r["rel_path"], "language": r["language"], "error": error, **out})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "rel_path", "language", "content", "error").mapInArrow(step, PARSED)
