from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import lines as L
from quarrylens.functions import names as N
from quarrylens.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "lang", "module"),
    [
        ("pkg/mod.py", "Python", "pkg.mod"), ("__init__.py", "Python", ""), ("pkg/__init__.py", "Python", "pkg"), ("a.py.py", "Python", "a"), ("X.PY", "Python", "X.PY"),
        ("src/index.ts", "TypeScript", "src"), ("src/a.jsx", "JavaScript", "src/a"), ("src/lib.rs", "Rust", "src"), ("a/b.rs", "Rust", "a::b"), ("cmd/x.go", "Go", "cmd/x"),
        ("com/A.java", "Java", "com.A"), ("x/y.hpp", "Cpp", "x::y"), ("x/y.h", "C", "x/y"),
    ],
)
def test_language_and_module(spark, path, lang, module):
    assert one(spark, S.language("p"), p=path) == lang
    assert one(spark, S.module_name("p", F.lit(lang)), p=path) == module


def test_exclusion(spark):
    cases = {"tests/a.py": True, "pkg/tests/a.py": False, "test_foo.py": True, "test/x.py": True, ".github/x.py": True, "myvenvtool.py": True, "a/node_modules/x.js": True, "src/a.py": False}
    for path, want in cases.items():
        assert one(spark, S.excluded("p"), p=path) == want, path
    assert one(spark, S.excluded("p", ("*.pb",)), p="a.pb") and one(spark, S.excluded("p", ("gen",)), p="x/gen/a.py")


def test_texts(spark):
    assert one(spark, S.slugify("s"), s="Hello, Wörld_x!") == "hello-wörld-x"
    assert one(spark, S.truncate_words("s", 2), s="a  b c") == "a b..." and one(spark, S.truncate_words("s", 3), s="a  b c") == "a  b c"
    assert one(spark, S.html_escape("s"), s="<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"
    assert one(spark, S.sanitize_class_name("s"), s="pkg.My<T>") == "MyT"
    assert one(spark, S.calls("s", "compile"), s="re.compile(x)") and not one(spark, S.calls("s", "compile"), s="recompile(x)")
    assert one(spark, S.string_arg("s"), s="f('a', \"b\")") == "b"
    assert one(spark, S.content_hash("s"), s="x") == hashlib.sha256(b"x").hexdigest()
    assert one(spark, S.url_path("s"), s="/a%20b+c?q=1") == "/a b+c"
    assert one(spark, S.content_type("s"), s="x/y.mmd") == "text/plain; charset=utf-8"


def test_stdlib_has_old_and_new_modules():
    assert {"os", "asyncio", "imp", "distutils", "typing_extensions", "__future__", "tomllib"} <= N.STDLIB and "numpy" not in N.STDLIB


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "# c\n\ndef f():\n    pass\n", "x = 1  # n\r\n\r\n#\n", "\u00a0\n\tx"])
def test_hash_lines_equal_a_plain_count(spark, text):
    lines = text.split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    want = (len(lines), sum(bool(x.strip()) and not x.strip().startswith("#") for x in lines), sum("#" in x for x in lines))
    assert tuple(one(spark, L.hash_comment_counts("t"), t=text)) == want


def test_block_lines(spark):
    js = "// c\nconst x = 1;\n/* block */\nfunction f() {}"
    assert tuple(one(spark, L.block_comment_counts("t", False), t=js)) == (4, 2, 2)
    text = "a\n/* x\n\n y */\nb\n\n"
    assert tuple(one(spark, L.block_comment_counts("t"), t=text)) == (6, 2, 3)
    assert tuple(one(spark, L.block_comment_counts("t", False), t=text)) == (6, 2, 2)


def test_template_filters_in_sql(spark):
    S.register(spark)
    r = spark.sql("SELECT slugify('A b'), truncate_words('a b c', 2), pluralize(1, 'file', 'files'), html_escape('<'), code_highlight('<')").first()
    assert list(r) == ["a-b", "a b...", "1 file", "&lt;", '<pre><code class="language-python">&lt;</code></pre>']
