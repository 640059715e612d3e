"""Scalar functions of the analysis as Spark columns. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import names as N

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def choose(key: Column, table: dict, default=None) -> Column:
    """CASE over a small fixed table: {result: keys}."""
    out = None
    for result, keys in table.items():
        hit = key.isin(*keys)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(F.lit(default))


def first_substring(s: Column, pairs, default: str) -> Column:
    out = None
    for part, result in pairs:
        out = F.when(s.contains(part), result) if out is None else out.when(s.contains(part), result)
    return out.otherwise(F.lit(default))


def extension(path: C) -> Column:
    """What follows the last dot of the last part; null without a dot or where only the first character is one."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def language(path: C) -> Column:
    by: dict[str, list] = {}
    for ext, lang in N.LANGUAGE_OF.items():
        by.setdefault(lang, []).append(ext)
    return choose(F.lower(extension(path)), by)


def js_variant(path: C) -> Column:
    by: dict[str, list] = {}
    for ext, v in N.JS_VARIANTS.items():
        by.setdefault(v, []).append(ext)
    return choose(F.lower(extension(path)), by)


def is_typescript(path: C) -> Column:
    return F.coalesce(js_variant(path).isin("Ts", "Tsx"), F.lit(False))


def excluded(rel_path: C, patterns=N.DEFAULT_EXCLUDE) -> Column:
    """Whether an exclude pattern or a built-in exclusion matches a path relative to the root."""
    p, hits = col(rel_path), []
    for pat in patterns:
        if "**" in pat:
            while pat.endswith("/**"):
                pat = pat[:-3]
            while pat.endswith("**"):
                pat = pat[:-2]
            hits.append(p.startswith(pat))
        elif pat.startswith("*."):
            while pat.startswith("*."):
                pat = pat[2:]
            hits.append(F.coalesce(extension(p) == pat, F.lit(False)))
        else:
            hits.append(p.contains(pat))
    hits += [p.contains(x) for x in N.ALWAYS_EXCLUDED]
    return reduce(lambda a, b: a | b, hits)


def module_name(rel_path: C, lang: C) -> Column:
    """Path parts without extension and index file, joined as the language joins them."""
    p, lang = col(rel_path), col(lang)
    stem = None
    for ext in N.EXTENSIONS:  # the first that fits is stripped, however often it stands there
        quoted = ext.replace(".", r"\.")
        strip = F.regexp_replace(p, f"({quoted})+$", "")
        stem = F.when(p.endswith(ext), strip) if stem is None else stem.when(p.endswith(ext), strip)
    parts = F.split(stem.otherwise(p), "/")
    index = None
    for k, files in N.INDEX_NAMES.items():
        hit = (lang == k) & F.element_at(parts, -1).isin(*files)
        index = hit if index is None else index | hit
    parts = F.when(F.coalesce(index, F.lit(False)), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = F.array_join(parts, ".")
    for sep in ("::", "/"):
        out = F.when(lang.isin(*[k for k, v in N.SEPARATORS.items() if v == sep]), F.array_join(parts, sep)).otherwise(out)
    return out


def module_type(dir_name: C) -> Column:
    return choose(F.lower(col(dir_name)), N.MODULE_TYPES, "Generic")


def slugify(s: C) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def truncate_words(s: C, count: int = 50) -> Column:
    words = F.filter(F.split(col(s), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > count, F.concat(F.array_join(F.slice(words, 1, count), " "), F.lit("..."))).otherwise(col(s))


def pluralize(n: C, singular: str, plural: str) -> Column:
    return F.concat(col(n).cast("string"), F.lit(" "), F.when(col(n) == 1, singular).otherwise(plural))


def html_escape(s: C) -> Column:
    out = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def code_highlight(s: C) -> Column:
    return F.concat(F.lit('<pre><code class="language-python">'), html_escape(s), F.lit("</code></pre>"))


def sanitize_id(s: C) -> Column:
    return F.regexp_replace(col(s), r"[^\p{L}\p{N}]", "_")


def sanitize_path_id(s: C) -> Column:
    """Node ids of the DOT and Mermaid exports: only `.`, `/`, `-` and blank become `_`."""
    return F.translate(col(s), "./- ", "____")


def sanitize_class_name(s: C) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(s), r"\."), -1), r"[^\p{L}\p{N}_]", "")


def node_style(module: C) -> Column:
    return first_substring(F.lower(col(module)), N.STYLES, "")


def node_color(module: C) -> Column:
    return first_substring(col(module), N.COLOURS, N.PLAIN_COLOUR)


def content_hash(s: C) -> Column:
    return F.sha2(col(s), 256)


def calls(line: C, function: str) -> Column:
    """Whether the line calls the function: its name before a parenthesis and not the end of a longer name."""
    quoted = function.replace(".", r"\.")
    found = col(line).contains(function + "(")  # a plain search first: the pattern is tried where it can match
    return found & col(line).rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}\(")


def string_arg(line: C) -> Column:
    """First double-quoted string of the line, else the first single-quoted one, else null."""
    s = col(line)
    return F.when(s.rlike('"[^"]*"'), F.regexp_extract(s, '"([^"]*)"', 1)).when(s.rlike("'[^']*'"), F.regexp_extract(s, "'([^']*)'", 1))


def complexity_label(lines: C) -> Column:
    return F.when(col(lines) <= 10, "Low").when(col(lines) <= 30, "Medium").otherwise("High")


def symbol_kind(s: C) -> Column:
    return choose(F.lower(col(s)), N.SYMBOL_KINDS, "Null")


def class_detail(doc: C) -> Column:
    """First line of a docstring; over 80 bytes it is cut to 77 characters and dots."""
    line = F.element_at(F.split(col(doc), "\n"), 1)
    return F.when(F.octet_length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line)


def url_path(s: C) -> Column:
    path = F.element_at(F.split(col(s), r"\?"), 1)
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)  # a malformed % stays as it is


def content_type(path: C) -> Column:
    by: dict[str, list] = {}
    for ext, mime in N.MIME.items():
        by.setdefault(mime, []).append(ext)
    return choose(extension(path), by, N.OTHER_MIME)


def used_name(alias: C, name: C) -> Column:
    return F.coalesce(col(alias), col(name))


def parameter_text(p: Column) -> Column:
    """`name`, `name=default`, `name: type`, `name: type = default`, with `*` or `**` before it."""
    prefix = F.when(p["kind"] == "Args", "*").when(p["kind"] == "Kwargs", "**").otherwise("")
    hint = F.coalesce(F.concat(F.lit(": "), p["type_hint"]), F.lit(""))
    value = F.coalesce(F.concat(F.when(p["type_hint"].isNotNull(), " = ").otherwise("="), p["default"]), F.lit(""))
    return F.concat(prefix, p["name"], hint, value)


def signature(is_async: C, name: C, parameters: C, return_type: C) -> Column:
    return F.concat(
        F.when(col(is_async), "async ").otherwise(""), F.lit("def "), col(name), F.lit("("),
        F.array_join(F.transform(col(parameters), parameter_text), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), col(return_type)), F.lit("")),
    )


# predicates on names, bases and decorators


def is_dataclass(decorators: C) -> Column:
    return F.exists(col(decorators), lambda d: d.contains("dataclass"))


def is_exception(bases: C) -> Column:
    return F.exists(col(bases), lambda b: b.contains("Exception") | b.contains("Error"))


def is_special(name: C) -> Column:
    return col(name).startswith("__") & col(name).endswith("__")


def is_private(name: C) -> Column:
    return col(name).startswith("_") & ~col(name).startswith("__")


def is_public(name: C) -> Column:
    return ~col(name).startswith("_")


def is_property(decorators: C) -> Column:
    return F.exists(col(decorators), lambda d: (d == "property") | d.endswith(".getter"))


def is_classmethod(decorators: C) -> Column:
    return F.array_contains(col(decorators), "classmethod")


def is_staticmethod(decorators: C) -> Column:
    return F.array_contains(col(decorators), "staticmethod")


def has_component_name(name: C) -> Column:
    return col(name).rlike(r"^\p{Lu}")


def is_conventional(name: C) -> Column:
    return col(name).rlike(r"^[\p{Lu}_\p{N}]*$")


def inherits_from(bases: C, base: str) -> Column:
    return F.exists(col(bases), lambda b: (b == base) | b.endswith("." + base))


def is_method(class_id: C) -> Column:
    return col(class_id).isNotNull()


def is_empty(classes: C, functions: C, constants: C) -> Column:
    """Whether a parsed file declares nothing; imports alone do not count."""
    return (F.size(col(classes)) == 0) & (F.size(col(functions)) == 0) & (F.size(col(constants)) == 0)


def public_methods(methods: C) -> Column:
    return F.filter(col(methods), lambda m: is_public(m["name"]))


def special_methods(methods: C) -> Column:
    return F.filter(col(methods), lambda m: is_special(m["name"]))


def is_test(name: C, decorators: C) -> Column:
    return col(name).startswith("test_") | F.exists(col(decorators), lambda d: d.contains("test"))


def top_level(module: C) -> Column:
    return F.element_at(F.split(col(module), r"\."), 1)


def is_stdlib(module: C, names=N.STDLIB) -> Column:
    return top_level(module).isin(*sorted(names))


def is_blank(doc: C) -> Column:
    return F.coalesce(F.regexp_replace(col(doc), r"(?U)^\s+|\s+$", ""), F.lit("")) == ""


def glob_match(pattern: str, s: C) -> Column:
    """`*` all, `p*` prefix, `*s` suffix, else equal."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*"):
        return col(s).startswith(pattern[:-1])
    if pattern.startswith("*"):
        return col(s).endswith(pattern[1:])
    return col(s) == pattern


# explanations: the sentences and prompts are fixed values


def _plural(n: Column, word: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise(many))


def explain_module(classes: C, functions: C) -> Column:
    c, f = col(classes), col(functions)
    cs, fs = _plural(c, "class", "es"), _plural(f, "function", "s")
    return (
        F.when((c == 0) & (f == 0), "This module contains only imports and constants.")
        .when((c > 0) & (f > 0), F.concat(F.lit("This module defines "), cs, F.lit(" and "), fs, F.lit(".")))
        .when(c > 0, F.concat(F.lit("This module defines "), cs, F.lit(".")))
        .otherwise(F.concat(F.lit("This module defines "), fs, F.lit(".")))
    )


def explain_class(name: C, methods: C, bases: C) -> Column:
    tail = F.when(F.size(col(bases)) > 0, F.concat(F.lit(" It inherits from "), F.array_join(col(bases), ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("The "), col(name), F.lit(" class has "), _plural(col(methods), "method", "s"), F.lit("."), tail)


def explain_function(name: C, is_async: C, parameters: C, return_type: C) -> Column:
    tail = F.coalesce(F.concat(F.lit(" Returns "), col(return_type), F.lit(".")), F.lit(""))
    kind = F.when(col(is_async), "async ").otherwise("")
    return F.concat(F.lit("The "), col(name), F.lit(" is an "), kind, F.lit("function that takes "), _plural(col(parameters), "parameter", "s"), F.lit("."), tail)


def or_none(items: C) -> Column:
    return F.when(F.size(col(items)) > 0, F.array_join(col(items), ", ")).otherwise("none")


def prompt(kind: str, sentences: str, **fields: Column) -> Column:
    parts = [F.lit(f"Explain this Python {kind} in {sentences} sentences. Be concise and technical.\n\n")]
    for label, value in fields.items():
        parts += [F.lit(label.replace("_", " ") + ": "), value, F.lit("\n")]
    return F.concat(*parts, F.lit("\nExplanation:"))


def register(spark: SparkSession) -> None:
    """The template filters as SQL functions, without Python on the executors."""
    sql = {
        "slugify": ("s STRING", "regexp_replace(regexp_replace(lower(s), '[^\\\\p{L}\\\\p{N}]+', '-'), '^-|-$', '')"),
        "truncate_words": ("s STRING, n INT", "CASE WHEN size(filter(split(s, '(?U)\\\\s+'), w -> w <> '')) > n THEN concat(array_join(slice(filter(split(s, '(?U)\\\\s+'), w -> w <> ''), 1, n), ' '), '...') ELSE s END"),
        "pluralize": ("n BIGINT, singular STRING, plural STRING", "concat(n, ' ', IF(n = 1, singular, plural))"),
        "html_escape": ("s STRING", "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&#39;')"),
        "code_highlight": ("s STRING", "concat('<pre><code class=\"language-python\">', replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&#39;'), '</code></pre>')"),
    }
    for name, (args, body) in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS STRING RETURN {body}")
