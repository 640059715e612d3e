"""Called names of a line against one pattern for each name."""

from __future__ import annotations

import re

from quarrylens.operators import dynamic as D

LINES = ["eval(x)", "my_eval(x)", "obj.eval(1); exec(eval(2))", "inspect.getmembers(a)", "x.inspect.getmembers (a)", "ainspect.getmembers(a)", "getmembers(a)", "a.__dict__", "a.varsity", "éval(1)", "5eval(2)", "..eval(3)",
         "  # eval(1)", "", "   ", "x = (1)", "vars(vars(locals()))", "m = importlib.import_module('a.b')", "__import__(\"q\") + eval('z')", "__import__", "type", "a.b.c.isinstance(d)", "dir(" * 200, "w" * 50_000 + "("]


def plain(line):
    if not line.strip() or line.strip().startswith("#"):
        return set()
    out = set()
    for c, functions in D.CALLS.items():
        for f in functions:
            if re.search(rf"(^|[^\w]){re.escape(f)}\(", line) or (f in D.N.DYNAMIC_ATTR and "." + f in line):
                out.add((c, f, None))
    if "(" in line and ("importlib.import_module" in line or "__import__" in line):
        arg = re.search('"([^"]*)"', line) or re.search("'([^']*)'", line)
        out.add(("dynamic_import", "importlib.import_module" if "importlib.import_module" in line else "__import__", arg and arg.group(1)))
    return out


def test_findings_equal_patterns(spark):
    df = spark.createDataFrame([(1, "\n".join(LINES)), (2, None), (3, "")], "k int, text string")
    got = [tuple(r) for r in D.findings(df, ["k"], "text").select("k", "line", "category", "function", "target").collect()]
    want = {(1, i + 1, *f) for i, line in enumerate(LINES) for f in plain(line)}
    assert len(got) == len(set(got)) and set(got) == want
    assert D.findings(df, ["k"], "text", calls={}, attributes=()).count() == 2  # imports by name alone
