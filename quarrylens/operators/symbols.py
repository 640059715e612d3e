"""Symbols: outline, lookups by position and by name, code lenses, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lines as L
from ..functions import scalars as S

PRIORITY = {"method": 1, "class": 2, "function": 3}


def build(files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """name, kind, path, line, end_line (from 0), container, ordinal of classes, methods and functions."""
    p = files.select("file_id", "path")
    at = lambda c: F.greatest(F.col(c) - 1, F.lit(0)).cast("int")
    cls = classes.join(p, "file_id")
    c = cls.select("name", F.lit("class").alias("kind"), "path", at("line_start").alias("line"), at("line_end").alias("end_line"), F.lit(None).cast("string").alias("container"), F.col("ordinal").cast("int").alias("ordinal"))
    names = classes.select("class_id", F.col("name").alias("container"))
    fn = functions.join(p, "file_id").join(names, "class_id", "left")
    f = fn.select("name", F.when(F.col("class_id").isNull(), "function").otherwise("method").alias("kind"), "path", at("line_start").alias("line"), at("line_end").alias("end_line"), "container", F.col("ordinal").cast("int").alias("ordinal"))
    return c.unionByName(f)


def _cells(start: str, end: str) -> Column:
    """The fewest aligned power-of-two ranges (level, cell) that cover the lines from start to end: two a level at most."""
    a, b = f"cast({start} as long)", f"(cast({end} as long) + 1)"
    lo, hi = f"(-shiftright(-{a}, k))", f"shiftright({b}, k)"  # first whole cell of the level, and the one behind the last
    one = lambda odd, cell: f"if({lo} < {hi} and {odd} % 2 <> 0, struct(k as level, {cell} as cell), null)"
    each = f"transform(sequence(0, {_LEVEL.format(a=a, b=b)}), k -> array({one(lo, lo)}, {one(hi, hi + ' - 1')}))"
    return F.expr(f"if({a} < {b}, filter(flatten({each}), c -> c is not null), null)")


#: Levels that a range from a to before b can need.
_LEVEL = "cast(ceil(log2(greatest({b} - {a}, 1) + 1)) as int)"


def at_position(probes: DataFrame, symbols: DataFrame, *probe_key: str) -> DataFrame:
    """The innermost symbol at (path, line): methods before classes before functions, then by order in the file.

    An interval structure: each symbol's lines are cut into aligned power-of-two cells, a cell keeps only its first
    symbol, and a line asks its cell of each level. So the work is symbols and probes times levels, however many symbols of
    a file overlap. Positions asked often are looked up once. Probes without a symbol keep a row (the module answers for them).
    """
    rank = S.choose(F.col("kind"), {v: (k,) for k, v in PRIORITY.items()}, 9)
    item = F.struct(rank.alias("rank"), "ordinal", F.col("line").alias("start"), "name", "kind", "end_line")
    cells = symbols.filter("path is not null").select("path", item.alias("s"), F.explode(_cells("line", "end_line")).alias("c")).groupBy("path", "c.level", "c.cell").agg(F.min("s").alias("s"))
    top = symbols.agg(F.max(F.expr(_LEVEL.format(a="cast(line as long)", b="(cast(end_line as long) + 1)")))).first()[0] or 0
    lines = probes.filter("path is not null and line is not null").select("path", "line").distinct()
    asked = lines.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("cell", F.expr("shiftright(cast(line as long), level)"))
    found = asked.join(cells, ["path", "level", "cell"]).groupBy("path", "line").agg(F.min("s").alias("s"))
    out = probes.select(*probe_key, "path", "line").join(found, ["path", "line"], "left")
    return out.select(*probe_key, "path", "line", F.coalesce("s.kind", F.lit("module")).alias("kind"), "s.name", "s.start", "s.end_line")


def definitions(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each asked `query`, the last symbol of exactly that name; else the first in order that differs in case only.

    symbols: name, seq and what else to return.
    """
    last = Window.partitionBy("name").orderBy(F.desc("seq"))
    exact = symbols.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = Window.partitionBy("__low").orderBy("seq")
    loose = symbols.withColumn("__low", fold("name")).withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    asked = names.select("query").distinct()
    a = asked.join(exact, F.col("query") == F.col("name"))
    b = asked.join(a.select("query"), "query", "left_anti").join(loose, fold("query") == F.col("__low")).drop("__low")
    return a.unionByName(b)


def workspace_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose name holds the query, in any case; an empty query gives all."""
    return symbols if not query else symbols.filter(F.lower("name").contains(query.lower()))


def document_symbols(symbols: DataFrame) -> DataFrame:
    """Outline of each file: classes with their methods as children, and functions."""
    item = F.struct("line", "end_line", "name")
    kids = symbols.filter("kind = 'method'").groupBy("path", F.col("container").alias("name")).agg(F.sort_array(F.collect_list(item)).alias("children"))
    top = symbols.filter("kind <> 'method'")
    return top.join(kids, ["path", "name"], "left").select("path", "name", "kind", "line", "end_line", F.when(F.col("kind") == "class", F.col("children")).alias("children"))


def code_lenses(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """`N methods` at the line of each class. classes: class_id, path, line; methods: class_id."""
    n = methods.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(n, "class_id", "left").select("class_id", "path", "line", F.format_string("%d methods", F.coalesce("n", F.lit(0))).alias("title"))


def search_index(modules: DataFrame, files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Modules, files, classes and top-level functions as search entries, in this order (seq)."""
    top = S.top_level("module_name")
    page = lambda m: F.concat(F.lit("modules/"), S.slugify(m), F.lit("/index.html"))
    none = F.lit(None).cast("string")
    f = files.select("file_id", "module_name", "docstring")
    m = modules.select(F.lit(0).alias("part"), F.col("module").alias("order"), F.col("module").alias("name"), F.lit("module").alias("kind"), page(F.col("module")).alias("path"), none.alias("description"), "module")
    file = f.select(F.lit(1).alias("part"), F.lpad(F.col("file_id").cast("string"), 20, "0").alias("order"), F.col("module_name").alias("name"), F.lit("file").alias("kind"), page(top).alias("path"), F.col("docstring").alias("description"), F.col("module_name").alias("module"))
    own = f.select("file_id", top.alias("module"))
    cls = classes.select("class_id", "file_id", "name", "docstring").join(own, "file_id")
    c = cls.select(F.lit(2).alias("part"), F.lpad(F.col("class_id").cast("string"), 20, "0").alias("order"), "name", F.lit("class").alias("kind"), F.concat(F.lit("modules/"), S.slugify("module"), F.lit("/"), S.slugify("name"), F.lit(".html")).alias("path"), F.col("docstring").alias("description"), "module")
    fns = functions.filter("class_id is null").select("function_id", "file_id", "name", "docstring").join(own, "file_id")
    g = fns.select(F.lit(3).alias("part"), F.lpad(F.col("function_id").cast("string"), 20, "0").alias("order"), "name", F.lit("function").alias("kind"), page(F.col("module")).alias("path"), F.col("docstring").alias("description"), "module")
    return m.unionByName(file).unionByName(c).unionByName(g)


def site_search(index: DataFrame, query: str, most: int = 10) -> DataFrame:
    """The first entries, in index order, whose name, description or module holds the query; a blank query finds none."""
    if not query.strip():
        return index.limit(0)
    q = query.lower()
    hit = F.lower("name").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False)) | F.lower("module").contains(q)
    return index.filter(hit).orderBy("part", "order").limit(most)


def _table(*rows: tuple[str, Column]) -> list[Column]:
    parts = [F.lit("| Property | Value |\n|----------|-------|\n")]
    for label, value in rows:
        parts += [F.lit(f"| {label} | "), value.cast("string"), F.lit(" |\n")]
    return parts


def _doc(doc: str) -> Column:
    return F.when(S.is_blank(doc), "").otherwise(F.concat(F.lit("\n---\n\n"), F.col(doc)))


def hover_class(name: str, methods: str, lines: str, imports: str, doc: str) -> Column:
    return F.concat(F.lit("## class "), F.col(name), F.lit("\n\n"), *_table(("Methods", F.col(methods)), ("Lines", F.col(lines)), ("File imports", F.col(imports))), _doc(doc))


def hover_module(name: str, language: str, dependencies: str, classes: str, functions: str, doc: str) -> Column:
    rows = (("Language", F.coalesce(language, F.lit("Unknown"))), ("Dependencies", F.col(dependencies)), ("Classes", F.col(classes)), ("Functions", F.col(functions)))
    return F.concat(F.lit("## Module: "), F.col(name), F.lit("\n\n"), *_table(*rows), _doc(doc))


def hover_function(signature: str, lines: str, container: str, doc: str) -> Column:
    inside = F.coalesce(F.concat(F.lit("| Container | "), F.col(container), F.lit(" |\n")), F.lit(""))
    return F.concat(F.lit("```\n"), F.col(signature), F.lit("\n```\n\n"), *_table(("Lines", F.col(lines)), ("Complexity", S.complexity_label(lines))), inside, _doc(doc))


def first_line(doc: str) -> Column:
    return F.element_at(L.lines_of(doc), 1)
