"""Diagram export: DOT, Mermaid, and images through Graphviz."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..engine import Analysis
from ..errors import ExportError
from ..operators import diagrams as D
from ..operators import graph as G

FORMATS = {"dot": "dot", "mermaid": "mermaid", "mmd": "mermaid", "svg": "svg", "png": "png"}


@dataclass
class Options:
    format: str = "mermaid"
    direction: str = "TB"
    depth: int = 5
    cluster: bool = False
    no_externals: bool = False
    modules: Sequence[str] = field(default_factory=tuple)


def format_of(name: str) -> str:
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ExportError(f"unknown export format: {name}") from None


def text(a: Analysis, o: Options) -> str:
    kind = format_of(o.format)
    of = a.module_files.select("file_id", "module")
    files = a.files.join(of, "file_id")
    files = G.filter_files(files, o.modules, project=of if o.no_externals else None).drop("module")
    edges = a.edges.select("src", "dst")
    lines = (D.mermaid if kind == "mermaid" else D.dot)(files, of, edges, o.direction, o.cluster)
    return D.text(lines)


def render(dot: str, kind: str) -> bytes:
    """Image bytes of DOT text, from the `dot` program."""
    if shutil.which("dot") is None:
        raise ExportError("graphviz (dot) not found. Install graphviz to export SVG/PNG.")
    done = subprocess.run(["dot", f"-T{kind}"], input=dot.encode(), capture_output=True, timeout=300)
    if done.returncode:
        raise ExportError(f"graphviz error: {done.stderr.decode(errors='replace')}")
    return done.stdout


def export(a: Analysis, o: Options) -> bytes:
    kind = format_of(o.format)
    out = text(a, o)
    return render(out, kind) if kind in ("svg", "png") else out.encode()


def export_to_file(a: Analysis, o: Options, path: str) -> None:
    data = export(a, o)
    with open(path, "wb") as f:
        f.write(data)
