"""Queries of scans, scalar functions, predicates and text patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import names as N
from ..functions import scalars as S
from ..operators import dynamic
from .registry import query, read

# one name for every page: its path below the host, with an extension from the page's number
EXTS = ("py", "js", "tsx", "rs", "go", "java", "c", "hpp", "txt", "PY")
_EXT_SQL = "list_value(" + ", ".join(f"'{e}'" for e in EXTS) + ")"
PATHS_SQL = f"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/]?([?#].*)?$', '') AS base,
  regexp_replace(regexp_replace(url, '^https?://', ''), '[/]?([?#].*)?$', '') || '.' || {_EXT_SQL}[page_id % {len(EXTS)} + 1] AS path FROM pages)"""


def paths(spark, sf_dir):
    """Pages as relative file paths."""
    base = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[/]?([?#].*)?$", "")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("page_id") % len(EXTS) + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.concat(base, F.lit("."), ext).alias("path"))


def _case(x: str, table: dict, default: str | None) -> str:
    rows = " ".join(f"WHEN {x} IN ({', '.join(repr(k) for k in keys)}) THEN '{r}'" for r, keys in table.items())
    return f"CASE {rows} ELSE {'NULL' if default is None else repr(default)} END"


def _by(table: dict) -> dict:
    out: dict[str, list] = {}
    for k, v in table.items():
        out.setdefault(v, []).append(k)
    return out


LANG_SQL = _case("lower(regexp_extract(path, '[^/.][^/]*\\.([^./]*)$', 1))", _by(N.LANGUAGE_OF), None)


@query("lang_detect", f"WITH {PATHS_SQL} SELECT page_id, path, {LANG_SQL} AS language, coalesce({_case(chr(108) + 'ower(regexp_extract(path, ' + repr('[.]([^./]*)$') + ', 1))', _by(N.JS_VARIANTS), None)} IN ('Ts', 'Tsx'), false) AS is_typescript FROM paths")
def lang_detect(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", "path", S.language("path").alias("language"), S.is_typescript("path").alias("is_typescript"))


@query("lang_counts", f"WITH {PATHS_SQL} SELECT language, count(*)::BIGINT AS files FROM (SELECT {LANG_SQL} AS language FROM paths) WHERE language IS NOT NULL GROUP BY language")
def lang_counts(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(S.language("path").alias("language")).agg(F.count("*").alias("files")).filter("language is not null")


PATTERNS = ("blog**", "*.txt", "/en/8", "m.th/**")


@query("exclude_filter", f"WITH {PATHS_SQL} SELECT page_id, path FROM paths WHERE NOT (starts_with(path, 'blog') OR regexp_matches(path, '[.]txt$') OR contains(path, '/en/8') OR starts_with(path, 'm.th') OR " + " OR ".join(f"contains(path, '{x}')" for x in N.ALWAYS_EXCLUDED) + ")")
def exclude_filter(spark, sf_dir):
    return paths(spark, sf_dir).filter(~S.excluded("path", PATTERNS)).select("page_id", "path")


@query("module_name", f"""WITH {PATHS_SQL}, l AS (SELECT page_id, path, {LANG_SQL} AS language FROM paths)
SELECT page_id, CASE WHEN language IN ('Rust', 'Cpp') THEN replace(s, '/', '::') WHEN language IN ('JavaScript', 'TypeScript', 'Go', 'C') THEN s ELSE replace(s, '/', '.') END AS module_name
FROM (SELECT *, regexp_replace(path, '([.]py|[.]js|[.]tsx|[.]rs|[.]go|[.]java|[.]c|[.]hpp)$', '') AS s FROM l)""")
def module_name(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("language", S.language("path"))
    return p.select("page_id", S.module_name("path", "language").alias("module_name"))


@query("module_type", f"SELECT s_suppkey, word, {_case('lower(word)', N.MODULE_TYPES, 'Generic')} AS module_type FROM (SELECT s_suppkey, list_value('Models','ui','handlers','SHARED','api','specs','conf','app','misc')[s_suppkey % 9 + 1] AS word FROM supplier)")
def module_type(spark, sf_dir):
    words = ("Models", "ui", "handlers", "SHARED", "api", "specs", "conf", "app", "misc")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", word.alias("word")).withColumn("module_type", S.module_type("word"))


@query("slugify", "SELECT page_id, trim(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.slugify("url").alias("slug"))


@query("truncate_words", """SELECT doc_id, CASE WHEN len(w) > 20 THEN array_to_string(list_slice(w, 1, 20), ' ') || '...' ELSE text END AS short
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def truncate_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.truncate_words("text", 20).alias("short"))


@query("pluralize", "SELECT o_orderkey, n || ' ' || CASE WHEN n = 1 THEN 'class' ELSE 'classes' END AS said FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def pluralize(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return n.select("o_orderkey", S.pluralize("n", "class", "classes").alias("said"))


_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("html_escape", f"SELECT page_id, sha256('<pre><code class=\"language-python\">' || {_ESC} || '</code></pre>') AS digest, length({_ESC})::INT AS n FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.content_hash(S.code_highlight("html")).alias("digest"), F.length(S.html_escape("html")).alias("n"))


@query("sanitize_ids", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') AS id, translate(url, './- ', '____') AS path_id, regexp_replace(string_split(url, '.')[-1], '[^\\p{L}\\p{N}_]', '', 'g') AS class_name FROM pages")
def sanitize_ids(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.sanitize_id("url").alias("id"), S.sanitize_path_id("url").alias("path_id"), S.sanitize_class_name("url").alias("class_name"))


NODE_WORDS = ("TestModel", "user_model", "util_view", "helpers", "api_test", "routes", "service", "Settings", "config", "plain")
_NODE_SQL = "(SELECT p_partkey, list_value(" + ", ".join(f"'{w}'" for w in NODE_WORDS) + ")[p_partkey % 10 + 1] || '.' || p_name AS module FROM part)"


def _substring_case(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{a}') THEN '{b}'" for a, b in pairs) + f" ELSE '{default}' END"


@query("node_style", f"SELECT p_partkey, {_substring_case('lower(module)', N.STYLES, '')} AS style, {_substring_case('module', N.COLOURS, N.PLAIN_COLOUR)} AS color FROM {_NODE_SQL}")
def node_style(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in NODE_WORDS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(word, F.lit("."), "p_name").alias("module"))
    return p.select("p_partkey", S.node_style("module").alias("style"), S.node_color("module").alias("color"))


@query("sha256_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def sha256_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.content_hash("text").alias("content_hash"))


# code-like lines from documents: the first word becomes a call, now and then with a longer name before it
_CODE = "replace(replace(replace(text, ' the ', ' eval('), ' und ', ' re.compile('), ' de ', ' x_eval(')"


@query("fn_call_match", f"SELECT doc_id, regexp_matches({_CODE}, '(^|[^\\p{{L}}\\p{{N}}_])eval\\(') AS evals, regexp_matches({_CODE}, '(^|[^\\p{{L}}\\p{{N}}_])compile\\(') AS compiles FROM documents")
def fn_call_match(spark, sf_dir):
    code = F.expr(_CODE)
    return read(spark, sf_dir, "documents").select("doc_id", S.calls(code, "eval").alias("evals"), S.calls(code, "compile").alias("compiles"))


@query("string_arg", """SELECT page_id, CASE WHEN regexp_matches(html, '"[^"]*"') THEN regexp_extract(html, '"([^"]*)"', 1) WHEN regexp_matches(html, '''[^'']*''') THEN regexp_extract(html, '''([^'']*)''', 1) END AS target FROM pages""")
def string_arg(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.string_arg("html").alias("target"))


@query("signature_fmt", """SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 'async ' ELSE '' END) || 'def order_' || o_orderkey || '(' ||
  string_agg(CASE WHEN l_returnflag = 'R' THEN '*' WHEN l_returnflag = 'A' THEN '**' ELSE '' END || 'p' || l_partkey || CASE WHEN l_linestatus = 'O' THEN ': int' ELSE '' END
    || CASE WHEN l_linenumber % 2 = 0 THEN (CASE WHEN l_linestatus = 'O' THEN ' = ' ELSE '=' END) || l_linenumber ELSE '' END, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)
  || ')' || CASE WHEN o_orderstatus = 'P' THEN ' -> ' || o_orderpriority ELSE '' END AS signature
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority""")
def signature_fmt(spark, sf_dir):
    p = F.struct(
        F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_returnflag").alias("k4"), F.col("l_linestatus").alias("k5"),
        F.concat(F.lit("p"), "l_partkey").alias("name"), F.when(F.col("l_linestatus") == "O", "int").alias("type_hint"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("default"),
        F.when(F.col("l_returnflag") == "R", "Args").when(F.col("l_returnflag") == "A", "Kwargs").otherwise("Regular").alias("kind"))
    params = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(p)).alias("params"))
    o = read(spark, sf_dir, "orders").join(params, F.col("l_orderkey") == F.col("o_orderkey"))
    ret = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    return o.select("o_orderkey", S.signature(F.col("o_orderstatus") == "F", F.concat(F.lit("order_"), "o_orderkey"), "params", ret).alias("signature"))


_LINES_SQL = r"""(SELECT doc_id, CASE WHEN src = '' THEN []::VARCHAR[] WHEN ls[-1] = '' THEN list_slice(ls, 1, len(ls) - 1) ELSE ls END AS ls FROM
  (SELECT doc_id, src, string_split(src, chr(10)) AS ls FROM (SELECT doc_id, {src} AS src FROM documents)))"""
_TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


@query("line_counts_py", f"""SELECT doc_id, len(ls)::BIGINT AS total, len(list_filter(ts, lambda x: x <> '' AND NOT starts_with(x, '#')))::BIGINT AS code, len(list_filter(ts, lambda x: contains(x, '#')))::BIGINT AS comment
FROM (SELECT doc_id, ls, list_transform(ls, lambda x: {_TRIM}) AS ts FROM {_LINES_SQL.format(src="text")})""")
def line_counts_py(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", L.hash_comment_counts("text").alias("c")).select("doc_id", "c.*")


_BLOCKY = "replace(replace(text, '###', chr(10) || '/* x' || chr(10) || chr(10)), '***', chr(10) || '*/' || chr(10))"


@query("line_counts_block", f"""WITH RECURSIVE l AS (SELECT doc_id, ls, list_transform(ls, lambda x: {_TRIM}) AS ts FROM {_LINES_SQL.format(src=_BLOCKY)}),
f AS (SELECT doc_id, 0 AS i, 0::BIGINT AS code, 0::BIGINT AS comment, false AS blk, ts FROM l
 UNION ALL SELECT doc_id, i + 1, code + CASE WHEN NOT blk AND ts[i+1] <> '' AND NOT starts_with(ts[i+1], '//') AND NOT starts_with(ts[i+1], '/*') THEN 1 ELSE 0 END,
  comment + CASE WHEN blk OR starts_with(ts[i+1], '//') OR starts_with(ts[i+1], '/*') THEN 1 ELSE 0 END,
  CASE WHEN blk THEN NOT contains(ts[i+1], '*/') ELSE starts_with(ts[i+1], '/*') AND NOT contains(ts[i+1], '*/') END, ts FROM f WHERE i < len(ts))
SELECT doc_id, i::BIGINT AS total, code, comment FROM f WHERE i = len(ts)""")
def line_counts_block(spark, sf_dir):
    text = F.expr("replace(replace(text, '###', '\\n/* x\\n\\n'), '***', '\\n*/\\n')")
    return read(spark, sf_dir, "documents").select("doc_id", L.block_comment_counts(text).alias("c")).select("doc_id", "c.*")


@query("complexity_label", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity <= 10 THEN 'Low' WHEN l_quantity <= 30 THEN 'Medium' ELSE 'High' END AS label FROM lineitem")
def complexity_label(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", S.complexity_label("l_quantity").alias("label"))


_PRED = "list_value('_hidden','__init__','Public','CONST_1','test_it','mid_Error','Änderung')"


@query("name_predicates", f"""SELECT p_partkey, name, starts_with(name, '_') AND NOT starts_with(name, '__') AS private, starts_with(name, '__') AND ends_with(name, '__') AS special, NOT starts_with(name, '_') AS public,
  regexp_matches(name, '^[\\p{{Lu}}_\\p{{N}}]*$') AS conventional, regexp_matches(name, '^\\p{{Lu}}') AS component, contains(name, 'Error') OR p_type = 'ECONOMY' AS exceptional
FROM (SELECT p_partkey, p_type, {_PRED}[p_partkey % 7 + 1] AS name FROM part)""")
def name_predicates(spark, sf_dir):
    words = ("_hidden", "__init__", "Public", "CONST_1", "test_it", "mid_Error", "Änderung")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 7 + 1).cast("int"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", word.alias("name"))
    return p.select(
        "p_partkey", "name", S.is_private("name").alias("private"), S.is_special("name").alias("special"), S.is_public("name").alias("public"),
        S.is_conventional("name").alias("conventional"), S.has_component_name("name").alias("component"),
        S.is_exception(F.array("name", F.when(F.col("p_type") == "ECONOMY", "builtins.Exception").otherwise(""))).alias("exceptional"))


@query("decorator_predicates", """SELECT o_orderkey, o_orderstatus = 'F' AS is_dataclass, o_orderstatus = 'P' AS is_property, o_orderpriority = '1-URGENT' AS is_classmethod, o_orderpriority = '2-HIGH' AS is_test,
 o_orderstatus <> 'O' AS inherits_base FROM orders""")
def decorator_predicates(spark, sf_dir):
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    deco = F.array(F.when(st == "F", "dataclasses.dataclass").when(st == "P", "x.getter").otherwise("other"), F.when(pr == "1-URGENT", "classmethod").when(pr == "2-HIGH", "pytest.mark.unit").otherwise("none"))
    bases = F.array(F.when(st == "F", "Base").when(st == "P", "pkg.Base").otherwise("NotBase"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", S.is_dataclass(deco).alias("is_dataclass"), S.is_property(deco).alias("is_property"), S.is_classmethod(deco).alias("is_classmethod"), S.is_test(F.lit("f"), deco).alias("is_test"), S.inherits_from(bases, "Base").alias("inherits_base"))


_WORDS_FOUND = {"dynamic_import": (), "eval_exec": ("the", "und"), "reflection": ("de", "la", "of"), "dynamic_attr": ("and", "in")}
_CODE_DOC = "regexp_replace(text, '([[:alpha:]]) ', '\\1( ', 'g')"


def _findings_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category, '{w}' AS function, line FROM ln WHERE regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_]){w}\\(')" for c, ws in _WORDS_FOUND.items() for w in ws
    )
    return f"""src AS (SELECT doc_id, string_split({_CODE_DOC}, chr(10)) AS ls FROM documents),
ln AS (SELECT * FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS x FROM src) WHERE NOT starts_with(trim(x), '#') AND trim(x) <> ''),
found AS ({rows})"""


def _findings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr("regexp_replace(text, '([a-zA-Z]) ', '$1( ')").alias("text"))
    return dynamic.findings(docs, ["doc_id"], "text", calls=_WORDS_FOUND, attributes=())


@query("dynamic_findings", f"WITH {_findings_sql()} SELECT doc_id, category, function, line::BIGINT AS line FROM found")
def dynamic_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "category", "function", "line")


@query("risk_score", f"WITH {_findings_sql()} SELECT doc_id, least(100, coalesce(sum(CASE category WHEN 'eval_exec' THEN 25 WHEN 'reflection' THEN 10 WHEN 'dynamic_attr' THEN 5 END), 0))::INT AS risk, count(category) > 0 AS has_dynamic_behavior FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id")
def risk_score(spark, sf_dir):
    return dynamic.risk(_findings(spark, sf_dir), ["doc_id"], read(spark, sf_dir, "documents").select("doc_id"))


@query("symbol_kinds", f"SELECT event_id, {_case('lower(w)', N.SYMBOL_KINDS, 'Null')} AS kind FROM (SELECT event_id, list_value('Class','fn','trait','let','field','package','signup')[event_id % 7 + 1] AS w FROM events)")
def symbol_kinds(spark, sf_dir):
    words = ("Class", "fn", "trait", "let", "field", "package", "signup")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", S.symbol_kind(word).alias("kind"))


@query("symbol_detail", "SELECT doc_id, CASE WHEN strlen(l) > 80 THEN left(l, 77) || '...' ELSE l END AS detail FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)")
def symbol_detail(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.class_detail("text").alias("detail"))


@query("url_and_mime", f"WITH {PATHS_SQL} SELECT page_id, url_decode(string_split(replace(url, '/', '%2F'), '?')[1]) AS decoded, {_case('regexp_extract(path, ' + repr('[.]([^./]*)$') + ', 1)', _by(N.MIME), N.OTHER_MIME)} AS mime FROM pages JOIN paths USING (page_id)")
def url_and_mime(spark, sf_dir):
    p = read(spark, sf_dir, "pages").join(paths(spark, sf_dir), "page_id")
    return p.select("page_id", S.url_path(F.expr("replace(url, '/', '%2F')")).alias("decoded"), S.content_type("path").alias("mime"))


@query("explain_templates", """SELECT o_orderkey, 'The order_' || o_orderkey || ' class has ' || n || CASE WHEN n = 1 THEN ' method.' ELSE ' methods.' END || CASE WHEN o_orderstatus = 'F' THEN ' It inherits from Base, Other.' ELSE '' END AS class_text,
 'The f is an ' || CASE WHEN o_orderstatus = 'O' THEN 'async ' ELSE '' END || 'function that takes ' || n || CASE WHEN n = 1 THEN ' parameter.' ELSE ' parameters.' END || CASE WHEN o_orderstatus = 'P' THEN ' Returns int.' ELSE '' END AS function_text,
 CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'This module contains only imports and constants.' WHEN n % 3 > 0 AND n % 2 > 0 THEN 'This module defines ' || n % 3 || CASE WHEN n % 3 = 1 THEN ' class' ELSE ' classes' END || ' and 1 function.'
  WHEN n % 3 > 0 THEN 'This module defines ' || n % 3 || CASE WHEN n % 3 = 1 THEN ' class.' ELSE ' classes.' END ELSE 'This module defines 1 function.' END AS module_text
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def explain_templates(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    st = F.col("o_orderstatus")
    bases = F.when(st == "F", F.array(F.lit("Base"), F.lit("Other"))).otherwise(F.array().cast("array<string>"))
    return o.select(
        "o_orderkey", S.explain_class(F.concat(F.lit("order_"), "o_orderkey"), "n", bases).alias("class_text"),
        S.explain_function(F.lit("f"), st == "O", "n", F.when(st == "P", "int")).alias("function_text"), S.explain_module(F.col("n") % 3, F.col("n") % 2).alias("module_text"))


@query("prompt_build", """SELECT o_orderkey, 'Explain this Python class in 2-3 sentences. Be concise and technical.' || chr(10) || chr(10) || 'Class: order_' || o_orderkey || chr(10) || 'File: orders.py' || chr(10) || 'Bases: none' || chr(10)
 || 'Methods: ' || string_agg('p' || l_partkey, ', ' ORDER BY l_partkey) || chr(10) || 'Docstring: ' || o_orderpriority || chr(10) || chr(10) || 'Explanation:' AS prompt FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def prompt_build(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("ps"))
    o = read(spark, sf_dir, "orders").join(m, F.col("l_orderkey") == F.col("o_orderkey"))
    methods = F.transform("ps", lambda x: F.concat(F.lit("p"), x.cast("string")))
    return o.select("o_orderkey", S.prompt("class", "2-3", Class=F.concat(F.lit("order_"), "o_orderkey"), File=F.lit("orders.py"), Bases=S.or_none(F.array().cast("array<string>")), Methods=S.or_none(methods), Docstring=F.col("o_orderpriority")).alias("prompt"))
