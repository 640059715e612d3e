"""Detection of dynamic code: imports by name, reflection, eval and exec, attribute tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import names as N
from ..functions import scalars as S

CALLS = {"reflection": N.REFLECTION, "eval_exec": N.EVAL_EXEC, "dynamic_attr": N.DYNAMIC_ATTR}

_WORD = r"[\p{L}\p{N}_]"
#: A dotted name before a parenthesis, from the begin of its first word; possessive, so that long words are read once.
_CALLED = rf"(?<!{_WORD})({_WORD}++(?:\.{_WORD}++)*+)\("


def _called(line: Column, names: Sequence[str]) -> Column:
    """Which of the names the line calls: its dotted names before a parenthesis, by as many last parts as a name has."""
    found = F.regexp_extract_all(line, F.lit(_CALLED), F.lit(1))
    last = lambda k: F.transform(found, lambda c: F.substring_index(c, ".", -k))
    ends = F.array(*[last(k) for k in sorted({n.count(".") + 1 for n in names})])
    return F.array_intersect(F.flatten(ends), F.array(*map(F.lit, names)))


def findings(files: DataFrame, key: Sequence[str], text: str, calls: dict = CALLS, attributes: Sequence[str] = N.DYNAMIC_ATTR) -> DataFrame:
    """key, category, function, line (from 1) and target: one row for each line and function.

    All called names of a line are extracted in one pass and met with the fixed list; nothing is joined or shuffled.
    """
    line = F.col("__line")
    category = {f: c for c, functions in calls.items() for f in functions}
    marked = [a for a in attributes if a in category]
    functions = _called(line, list(category)) if category else F.array().cast("array<string>")
    if marked:
        functions = F.array_union(functions, F.filter(F.array(*map(F.lit, marked)), lambda a: line.contains(F.concat(F.lit("."), a))))
    item = "struct<category: string, function: string, target: string>"
    of = F.create_map(*[F.lit(x) for pair in category.items() for x in pair]).cast("map<string, string>")
    hits = F.transform(functions, lambda f: F.struct(F.element_at(of, f).alias("category"), f.alias("function"), F.lit(None).cast("string").alias("target")).cast(item))
    module = line.contains("importlib.import_module") & line.contains("(")
    dunder = line.contains("__import__") & line.contains("(")
    by_name = F.struct(F.lit("dynamic_import").alias("category"), F.when(module, "importlib.import_module").otherwise("__import__").alias("function"), S.string_arg(line).alias("target")).cast(item)
    hits = F.concat(hits, F.when(module | dunder, F.array(by_name)).otherwise(F.array().cast(f"array<{item}>")))
    # a line without a parenthesis or one of the attributes is left out before anything is extracted
    lines = files.select(*key, F.posexplode(L.lines_of(text)).alias("__pos", "__line")).filter(reduce(or_, [line.contains("." + a) for a in marked], line.contains("(")))
    code = L.trimmed(line)
    lines = lines.filter((code != "") & ~code.startswith("#"))
    found = lines.select(*key, (F.col("__pos") + 1).cast("long").alias("line"), F.explode(hits).alias("f"))
    return found.select(*key, "f.category", "f.function", "line", "f.target")


def risk(found: DataFrame, key: Sequence[str], files: DataFrame) -> DataFrame:
    """Score from 0 to 100 of every file, and whether anything was found."""
    weight = None
    for category, w in N.RISK_WEIGHTS.items():
        weight = F.when(F.col("category") == category, w) if weight is None else weight.when(F.col("category") == category, w)
    sums = found.groupBy(*key).agg(F.sum(weight).alias("points"))
    out = files.join(sums, list(key), "left")
    return out.select(*key, F.least(F.lit(100), F.coalesce("points", F.lit(0))).cast("int").alias("risk"), F.col("points").isNotNull().alias("has_dynamic_behavior"))
