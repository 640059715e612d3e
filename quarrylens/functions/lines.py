"""Line counts of source texts as Spark columns: total, code and comment lines, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import C, col


def lines_of(text: C) -> Column:
    """Lines without their ends; a last line end opens no new line."""
    parts = F.split(col(text), "\r?\n")
    return F.when(col(text) == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def total_lines(text: C) -> Column:
    return F.size(lines_of(text)).cast("long")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used: lambdas share no common subexpressions."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _count(text: C) -> Column:
    """Number of lines, from the line ends alone."""
    t = col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)).cast("long")


def _trimmed_lines(text: C) -> Column:
    """The lines without blanks at their edges, trimmed in one pass over the text."""
    return F.split(F.regexp_replace(col(text), r"(?Umd)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""), "\n")


def hash_comment_counts(text: C) -> Column:
    """struct(total, code, comment) for `#` languages: a code line that holds a `#` counts as both."""

    def sums(t: Column) -> Column:
        code = F.size(F.filter(t, lambda x: (x != "") & ~x.startswith("#")))
        comment = F.size(F.filter(t, lambda x: x.contains("#")))
        return F.struct(_count(text).alias("total"), code.cast("long").alias("code"), comment.cast("long").alias("comment"))

    return _let(_trimmed_lines(text), sums)


def block_comment_counts(text: C, blank_in_block: bool = True) -> Column:
    """struct(total, code, comment) for languages with `//` and `/* */`; blank lines in a block count if so told."""
    zero = F.struct(F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("comment"), F.lit(False).alias("block"))

    def step(s: Column, t: Column) -> Column:
        blank = t == ""
        inside = s["block"]
        opens = t.startswith("/*")
        is_comment = F.when(blank, inside & F.lit(blank_in_block)).otherwise(inside | opens | t.startswith("//"))
        is_code = ~blank & ~is_comment
        block = F.when(blank, inside).when(inside, ~t.contains("*/")).otherwise(opens & ~t.contains("*/"))
        return F.struct((s["code"] + is_code.cast("long")).alias("code"), (s["comment"] + is_comment.cast("long")).alias("comment"), block.alias("block"))

    lines = F.slice(_trimmed_lines(text), F.lit(1), F.greatest(_count(text), F.lit(0)).cast("int"))
    folded = F.aggregate(lines, zero, step, lambda s: F.struct(_count(text).alias("total"), s["code"].alias("code"), s["comment"].alias("comment")))
    return folded


def counts(text: C, lang: C) -> Column:
    """By language: `#` for Python, blocks for the others; JavaScript and TypeScript skip blank lines first."""
    script = col(lang).isin("JavaScript", "TypeScript")
    return F.when(col(lang) == "Python", hash_comment_counts(text)).when(script, block_comment_counts(text, False)).otherwise(block_comment_counts(text))
