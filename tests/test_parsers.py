from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans import registry
from quarrylens.sources.parsers import parse_source

PY = '''"""Doc of module."""
import os, sys as system
from ..pkg.mod import thing as other, more
LIMIT: int = 3
lower = 1
SAME = LIMIT

@dataclass
class Point(Base, metaclass=Meta):
    """A point."""
    x: int = 0
    _hidden = 1

    @property
    def size(self) -> int:
        """Its size."""
        return 1

async def run(a, /, b: str, *rest, c=1, **kw) -> None:
    yield a
'''


def names(rows):
    return [r["name"] for r in rows]


def test_python():
    r = parse_source(PY, "Python")
    assert r["docstring"] == "Doc of module." and names(r["constants"]) == ["LIMIT", "SAME"]
    assert [(i["module"], i["kind"], i["level"]) for i in r["imports"]] == [("os", "Direct", None), ("sys", "Direct", None), ("pkg.mod", "Relative", 2)]
    assert r["imports"][2]["names"] == [{"name": "thing", "alias": "other"}, {"name": "more", "alias": None}]
    c, f = r["classes"][0], r["functions"][0]
    assert (c["name"], c["bases"], c["decorators"], c["docstring"], names(c["attributes"])) == ("Point", ["Base"], ["dataclass"], "A point.", ["x"])
    assert (c["line_start"], c["line_end"]) == (8, 17) and c["methods"][0]["decorators"] == ["property"] and c["methods"][0]["return_type"] == "int"
    assert [(p["name"], p["kind"]) for p in f["parameters"]] == [("a", "PositionalOnly"), ("b", "Regular"), ("rest", "Args"), ("c", "KeywordOnly"), ("kw", "Kwargs")]
    assert f["is_async"] and f["is_generator"]


def test_python_compat_differences():
    r = parse_source(PY, "Python", compat=True)
    assert r["classes"] == [] and names(r["constants"]) == ["LIMIT", "LIMIT"]  # decorated class lost, X = Y renamed
    assert r["imports"][0]["module"] == "os" and len(r["imports"]) == 2 and not r["functions"][0]["is_generator"]
    plain = parse_source("def f(a, b=1): pass", "Python", compat=True)["functions"][0]["parameters"]
    assert [p["kind"] for p in plain] == ["PositionalOnly", "Regular"]


def test_python_that_does_not_parse_is_read_by_line():
    r = parse_source("import a\nclass X:\n  def f(self)\n    pass\ndef g(:\n  x\n", "Python")
    assert names(r["classes"]) == ["X"] and names(r["functions"]) == ["g"] and r["imports"][0]["module"] == "a"


def test_javascript():
    r = parse_source(
        """import React, { useState as us } from 'react';
import * as path from "path";
import './side.css';
const { a, b: c } = require('./lib');
/** Shop item. */
export class Item extends Base {
  count = 1;
  async load(id, ...rest) { if (id) { go(); } }
}
export async function fetchAll(x = 1) { return x; }
const Card = ({ title }) => { return <div>{title}</div>; };
const add = (p, q) => p + q;
""",
        "JavaScript",
    )
    assert [(i["module"], i["kind"]) for i in r["imports"]] == [("react", "From"), ("path", "From"), ("./side.css", "Relative"), ("./lib", "Relative")]
    assert r["imports"][0]["names"][1] == {"name": "useState", "alias": "us"}
    c = r["classes"][0]
    assert (c["name"], c["bases"], names(c["methods"]), names(c["attributes"]), c["docstring"]) == ("Item", ["Base"], ["load"], ["count"], "Shop item.")
    assert names(r["functions"]) == ["fetchAll", "Card", "add"] and [f["is_component"] for f in r["functions"]] == [False, True, False]
    assert r["functions"][0]["is_async"] and c["methods"][0]["parameters"][1]["kind"] == "Args"


def test_rust():
    r = parse_source(
        """//! Crate doc.
use std::collections::{HashMap, HashSet as S};
use crate::a::B;
mod util;
pub const MAX: usize = 10;
/// A thing.
#[derive(Debug)]
pub struct Thing<'a> { pub name: &'a str }
enum Kind { A, B }
pub trait Run { fn run(&self); }
impl Run for Thing<'_> { fn run(&self) {} }
impl<'a> Thing<'a> { pub fn new(name: &'a str) -> Self { Thing { name } } }
pub async fn main_loop(n: u32) -> Result<(), E> { loop {} }
""",
        "Rust",
    )
    assert [(i["module"], i["kind"]) for i in r["imports"]] == [("std::collections", "From"), ("crate::a", "From"), ("util", "Relative")]
    assert [(c["name"], c["bases"]) for c in r["classes"]] == [("Thing", []), ("Kind", ["Enum"]), ("Run", ["Trait"])]
    assert names(r["functions"]) == ["Thing::Run::run", "Thing::new", "main_loop"] and names(r["constants"]) == ["MAX"]
    assert r["functions"][2]["is_async"] and r["classes"][0]["decorators"] == ["#[derive(Debug)]"] and names(r["classes"][2]["methods"]) == ["run"]


def test_go():
    r = parse_source(
        """package shop
import (
\t"fmt"
\tj "encoding/json"
)
const Limit, Other = 1, 2
// Item is sold.
type Item struct {
\tName string
}
type Runner interface {
\tRun(n int) error
}
type ID int
func (i *Item) Price(tax float64, rest ...int) float64 { return 1 }
func New() *Item { return nil }
""",
        "Go",
    )
    assert r["docstring"] == "package shop" and [i["module"] for i in r["imports"]] == ["fmt", "encoding/json"]
    assert [(c["name"], c["bases"]) for c in r["classes"]] == [("Item", []), ("Runner", ["Interface"]), ("ID", ["TypeAlias"])]
    assert names(r["functions"]) == ["Item.Price", "New"] and r["functions"][0]["parameters"][1]["kind"] == "Args" and names(r["constants"]) == ["Limit", "Other"]
    assert r["classes"][0]["docstring"] == "Item is sold." and names(r["classes"][1]["methods"]) == ["Run"]


def test_java():
    r = parse_source(
        """package com.shop;
import java.util.List;
import static java.lang.Math.*;
/** Sells things.
 * @author x */
public class Shop extends Base implements Open, Close {
  private final int size = 3;
  public Shop(int size) { this.size = size; }
  @Override public List<String> names(String... more) { return null; }
}
interface Open extends A {}
enum Color { RED, GREEN }
record Point(int x, int y) {}
""",
        "Java",
    )
    assert r["docstring"] == "package com.shop" and [i["module"] for i in r["imports"]] == ["java.util.List", "static java.lang.Math.*"]
    assert [(c["name"], c["bases"]) for c in r["classes"]] == [("Shop", ["Base", "Open", "Close"]), ("Open", ["Interface", "A"]), ("Color", ["Enum"]), ("Point", ["Record"])]
    c = r["classes"][0]
    assert names(c["methods"]) == ["Shop", "names"] and names(c["attributes"]) == ["size"] and c["docstring"] == "Sells things." and c["methods"][1]["parameters"][0]["kind"] == "Args"
    assert names(r["classes"][2]["attributes"]) == ["RED", "GREEN"] and names(r["classes"][3]["attributes"]) == ["x", "y"]


def test_c_and_cpp():
    r = parse_source('#include <stdio.h>\n#include "a.h"\nint counter = 0;\nint add(int a, int b);\n/* sums */\nint add(int a, int b) {\n  return a + b;\n}\nstruct P { int x; };\ntypedef unsigned int uint;\nenum E { A, B };\nvoid log_it(const char *f, ...) { }\n', "C")
    assert [i["module"] for i in r["imports"]] == ["stdio.h", "a.h"] and names(r["constants"]) == ["counter"]
    assert [(f["name"], f["decorators"]) for f in r["functions"]] == [("add", ["prototype"]), ("add", []), ("log_it", [])] and r["functions"][2]["parameters"][-1]["kind"] == "Args"
    assert [(c["name"], c["bases"]) for c in r["classes"]] == [("P", ["struct"]), ("uint", ["typedef"]), ("E", ["enum"])]
    p = parse_source("#include <vector>\nusing std::vector;\nnamespace a { namespace b {\nclass Shape : public Base {\npublic:\n  virtual double area() const = 0;\n  static Shape* make(int n) { return 0; }\n};\ntemplate <typename T>\nT top(T a) { return a; }\n} }\n", "Cpp")
    assert [(c["name"], c["bases"]) for c in p["classes"]] == [("a::b::Shape", ["Base"])] and names(p["classes"][0]["methods"]) == ["area", "make"]
    assert names(p["functions"]) == ["a::b::top"] and "template" in p["functions"][0]["decorators"] and p["imports"][1]["module"] == "std"


def test_odd_sources_are_never_rejected():
    for lang in ("Python", "JavaScript", "TypeScript", "Rust", "Go", "Java", "C", "Cpp"):
        for text in ("", "{{{", "}}} ((", "\x00", "'unclosed", "/* open", "class", "äöü 漢字 " * 10):
            assert set(parse_source(text, lang)) == {"docstring", "imports", "classes", "functions", "constants"}


def test_one_small_file_of_parts_is_parsed_by_all_tasks(spark, sf):
    """part is one file of a few kB, whatever number of sources it makes."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for language in ("cpp", "python", "rust"):
        parsed = registry.QUERIES[f"parse_{language}"](spark, sf)
        used = parsed.select(F.spark_partition_id().alias("p")).distinct().count()
        assert parsed.rdd.getNumPartitions() == tasks and used > 1
