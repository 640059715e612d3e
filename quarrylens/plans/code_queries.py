"""Queries of dynamic code with the operator's own lists, over whole texts made like code: frequent words become calls, attributes and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import dynamic
from .registry import query, read

AS_CODE = (
    (" the ", " eval("), (" of ", " inspect.getmembers("), (" and ", " x.__dict__ "), (" de ", " y.getattr(z, "), (" la ", " vars("), (" und ", ' importlib.import_module("mod") '),
    (" der ", " __import__('other') "), (" le ", " not_exec("), (" to ", " compile("), (" a ", " locals() "),
)


def _found_sql() -> str:
    text = "text"
    for a, b in AS_CODE:
        text = "replace({}, '{}', '{}')".format(text, a, b.replace("'", "''"))
    rows = []
    for category, functions in dynamic.CALLS.items():
        for f in functions:
            hit = r"regexp_matches(x, '(^|[^\p{L}\p{N}_])" + f.replace(".", r"\.") + r"\(')"
            if f in N.DYNAMIC_ATTR:
                hit += f" OR contains(x, '.{f}')"
            rows.append(f"SELECT doc_id, '{category}' AS category, '{f}' AS function, line, NULL AS target FROM ln WHERE {hit}")
    rows.append("""SELECT doc_id, 'dynamic_import', CASE WHEN contains(x, 'importlib.import_module') THEN 'importlib.import_module' ELSE '__import__' END, line,
  CASE WHEN regexp_matches(x, '"[^"]*"') THEN regexp_extract(x, '"([^"]*)"', 1) WHEN regexp_matches(x, '''[^'']*''') THEN regexp_extract(x, '''([^'']*)''', 1) END
  FROM ln WHERE (contains(x, 'importlib.import_module') OR contains(x, '__import__')) AND contains(x, '(')""")
    return f"""src AS (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM documents),
ln AS (SELECT * FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS x FROM src) WHERE NOT starts_with(trim(x), '#') AND trim(x) <> ''),
found AS ({" UNION ALL ".join(rows)})"""


def _found(spark, sf_dir):
    text = F.col("text")
    for a, b in AS_CODE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return dynamic.findings(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), ["doc_id"], "text")


@query("dynamic_code", f"WITH {_found_sql()} SELECT doc_id, category, function, line::BIGINT AS line, target FROM found")
def dynamic_code(spark, sf_dir):
    return _found(spark, sf_dir)


@query("dynamic_code_risk", f"""WITH {_found_sql()} SELECT doc_id, least(100, coalesce(sum(CASE category WHEN 'eval_exec' THEN 25 WHEN 'dynamic_import' THEN 15 WHEN 'reflection' THEN 10 WHEN 'dynamic_attr' THEN 5 END), 0))::INT AS risk,
 count(category) > 0 AS has_dynamic_behavior FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""")
def dynamic_code_risk(spark, sf_dir):
    return dynamic.risk(_found(spark, sf_dir), ["doc_id"], read(spark, sf_dir, "documents").select("doc_id"))
