"""Explanations of modules, classes and functions: from templates, or from a function the caller gives."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Llm
from ..engine import Analysis
from ..errors import ConfigError
from ..functions import scalars as S


def requests(a: Analysis) -> DataFrame:
    """kind, id, prompt and the template's text of everything that can be explained."""
    names = lambda df, key, c: df.groupBy(key).agg(F.sort_array(F.collect_list(c)).alias(c))
    empty = F.array().cast("array<string>")
    fill = lambda c: F.coalesce(c, empty)
    c = names(a.classes.select("file_id", F.col("name").alias("cs")), "file_id", "cs")
    f = names(a.functions.filter("class_id is null").select("file_id", F.col("name").alias("fs")), "file_id", "fs")
    i = names(a.imports.select("file_id", F.col("module").alias("im")), "file_id", "im")
    m = a.files.join(c, "file_id", "left").join(f, "file_id", "left").join(i, "file_id", "left").withColumns({k: fill(k) for k in ("cs", "fs", "im")})
    module = m.select(F.lit("module").alias("kind"), F.col("file_id").alias("id"), S.prompt("module", "2-3", File=F.col("path"), Classes=S.or_none("cs"), Functions=S.or_none("fs"), Imports=S.or_none("im")).alias("prompt"), S.explain_module(F.size("cs"), F.size("fs")).alias("template"))
    ms = names(a.functions.filter("class_id is not null").select("class_id", F.col("name").alias("ms")), "class_id", "ms")
    k = a.classes.join(a.files.select("file_id", "path"), "file_id").join(ms, "class_id", "left").withColumn("ms", fill("ms"))
    doc = F.coalesce("docstring", F.lit("none"))
    klass = k.select(F.lit("class").alias("kind"), F.col("class_id").alias("id"), S.prompt("class", "2-3", Class=F.col("name"), File=F.col("path"), Bases=S.or_none("bases"), Methods=S.or_none("ms"), Docstring=doc).alias("prompt"), S.explain_class("name", F.size("ms"), "bases").alias("template"))
    ps = F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type_hint"]), F.lit(""))))
    fn = a.functions.join(a.files.select("file_id", "path"), "file_id")
    func = fn.select(
        F.lit("function").alias("kind"), F.col("function_id").alias("id"),
        S.prompt("function", "1-2", Function=F.col("name"), Context=F.col("path"), Parameters=S.or_none(ps), Returns=F.coalesce("return_type", F.lit("unspecified")), Docstring=doc, Is_async=F.col("is_async").cast("string")).alias("prompt"),
        S.explain_function("name", "is_async", F.size("parameters"), "return_type").alias("template"))
    return module.unionByName(klass).unionByName(func)


def provider_of(llm: Llm, timeout: float = 60.0) -> Callable[[str], str] | None:
    """The provider that the configuration names, as a function from prompt to text; None where explanations are off."""
    if not llm.enabled:
        return None
    if llm.provider == "openai":
        key = llm.api_key or os.environ.get("OPENAI_API_KEY")
        if not key:
            raise ConfigError("OpenAI API key not configured")
        url, head = f"{llm.api_url or 'https://api.openai.com/v1'}/chat/completions", {"Authorization": f"Bearer {key}"}
        body, text = lambda p: {"model": llm.model, "messages": [{"role": "user", "content": p}]}, lambda r: r["choices"][0]["message"]["content"]
    else:
        url, head = f"{llm.api_url or 'http://localhost:11434'}/api/generate", {}
        body, text = lambda p: {"model": llm.model, "prompt": p, "stream": False}, lambda r: r["response"]

    def ask(prompt: str) -> str:
        request = urllib.request.Request(url, json.dumps(body(prompt)).encode(), {"Content-Type": "application/json", **head})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return text(json.load(answer))

    return ask


def explain(asked: DataFrame, provider: Callable[[str], str] | None = None) -> DataFrame:
    """kind, id, text. Equal prompts are asked once; any error of the provider gives the template's text."""
    if provider is None:
        return asked.select("kind", "id", F.col("template").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("prompt").to_pylist():
                try:
                    out.append(provider(p))
                except Exception:  # the template stands in
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("prompt"), pa.array(out, pa.string())], ["prompt", "answer"])

    answers = asked.select("prompt").distinct().mapInArrow(step, "prompt string, answer string")
    return asked.join(answers, "prompt").select("kind", "id", F.coalesce("answer", "template").alias("text"))
