"""Command line: analyze, export, serve, version."""

from __future__ import annotations

import argparse
import functools
import http.server
import os
import sys

from pyspark.sql import SparkSession

from . import __version__
from .config import Config
from .engine import Engine
from .errors import AnalysisError
from .render import export, report
from .sources.scan import discover, file_counts


def _session() -> SparkSession:
    return SparkSession.builder.appName("quarrylens").getOrCreate()


def _analyze(args) -> int:
    config = Config.load_or_default(args.config).merge_cli(args.output, args.exclude, args.format, args.depth, args.no_diagrams, args.no_explain)
    config.validate()
    spark = _session()
    if args.verbose:
        for r in file_counts(discover(spark, args.path, config.analysis.exclude)).orderBy("language").collect():
            print(f"{r.language}: {r.files} files")
    a = Engine(spark, config, cache=args.cache).analyze(args.path)
    out = config.output.directory
    os.makedirs(out, exist_ok=True)
    if config.output.format == "json":
        report.write_json(a, os.path.join(out, "analysis.json"))
    elif config.output.format == "markdown":
        with open(os.path.join(out, "README.md"), "w", encoding="utf-8") as f:
            f.write(report.markdown(a))
    else:
        report.write_site(a, out)
    print(report.console_summary(a))
    return 0


def _export(args) -> int:
    config = Config()
    if args.exclude:
        config.analysis.exclude = list(args.exclude)
    a = Engine(_session(), config).analyze(args.path)
    o = export.Options(args.format, args.direction, args.depth, args.cluster, args.no_externals, tuple(args.module))
    if args.output:
        export.export_to_file(a, o, args.output)
    else:
        sys.stdout.buffer.write(export.export(a, o) + b"\n")
    return 0


class _Handler(http.server.SimpleHTTPRequestHandler):
    """GET only, below the served folder."""

    def _no(self):
        self.send_error(405)

    do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = _no

    def list_directory(self, path):
        self.send_error(404)


def _serve(args) -> int:
    handler = functools.partial(_Handler, directory=os.path.realpath(args.path))
    with http.server.ThreadingHTTPServer((args.host, args.port), handler) as server:
        print(f"Serving {args.path} at http://{args.host}:{server.server_port}")
        server.serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylens", description="Analyses source trees with Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("-o", "--output")
    a.add_argument("-c", "--config", default="quarrylens.toml")
    a.add_argument("-e", "--exclude", action="append", default=[])
    a.add_argument("-f", "--format")
    a.add_argument("-d", "--depth", type=int)
    a.add_argument("--no-diagrams", action="store_true")
    a.add_argument("--no-explain", action="store_true")
    a.add_argument("--cache", help="folder for incremental analysis")
    a.add_argument("-v", "--verbose", action="store_true")
    a.set_defaults(run=_analyze)
    e = sub.add_parser("export")
    e.add_argument("path")
    e.add_argument("-f", "--format", default="mermaid")
    e.add_argument("-o", "--output")
    e.add_argument("-e", "--exclude", action="append", default=[])
    e.add_argument("-m", "--module", action="append", default=[])
    e.add_argument("--direction", default="TB")
    e.add_argument("--depth", type=int, default=5)
    e.add_argument("--cluster", action="store_true")
    e.add_argument("--no-externals", action="store_true")
    e.set_defaults(run=_export)
    s = sub.add_parser("serve")
    s.add_argument("path")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8080)
    s.set_defaults(run=_serve)
    sub.add_parser("version").set_defaults(run=lambda _: print(f"quarrylens {__version__}") or 0)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except AnalysisError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
