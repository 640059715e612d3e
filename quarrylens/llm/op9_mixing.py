"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are words. Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the total size; a target
stops at `most` times its source's size and the excess is shared again by weight. Every document of a source then
has the same expected number of copies, a whole part plus a fraction. Two fractions at a time are paired and words
are moved from one to the other at random, so that each document keeps its expectation, until one of the two is
integral; larger documents come first, so that what stays open is small. Chunks of a source are rounded side by side; the one fraction that each chunk leaves goes up a reduction
tree, and the last one of a source is settled by a draw. A source so takes its target to within one document.

The table of sources stays in Spark: it is numbered by range partitions, and the shares follow from sums by weight,
as many rounds as targets reach their limit. Documents meet it by a join that splits hot sources.

Defined results: a null text has size 0; size-0 documents are taken 0 times; rows are told apart by (doc_id, size),
equal rows are interchangeable, a null doc_id sorts first; an empty table gives an empty result; other columns are ignored.
Only (doc_id, source index, size) is shuffled, in chunks of about CHUNK rows by hash; equal rows are counted before, and
CHUNK of them at most go to a chunk together. So a source, or one row repeated, with most of the rows spreads over many tasks. `repeat` hands on all columns whatever their names; rows that are equal in all of them
are counted together.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entities import number
from .common import WORD_RE, checkpointed, renamed, table
from .components import spread_join

CHUNK = 2048
FAN_IN = 64
CYCLE = (1, 2, 3)
_COLS = ["doc_id", "row", "src", "size", "chunk", "copies", "p"]
_DDL = "doc_id long, row binary, src long, size long, chunk long, copies int, p double"


def water_fill(sources: DataFrame, most: int = 3) -> DataFrame:
    """`target` (double) of sources (s: size, w: weight): sum(s) shared by weight, none above `most` times its size.

    Targets that reach the limit are fixed and the rest is shared again, until none is above. Sums are exact.
    """
    total = sources.agg(F.sum("s")).first()[0] or 0
    done = F.col("s") == 0
    count = None
    while True:
        row = sources.agg(F.sum(F.when(done, F.col("s"))), F.sum(F.when(~done, F.col("w"))), F.count(F.when(done, 1))).first()
        left, weights = total - most * int(row[0] or 0), int(row[1] or 0)
        if row[2] == count or not weights:
            break
        count = row[2]
        # left * w > most * s * weights, in integers of up to 38 digits
        over = F.lit(Decimal(left)).cast("decimal(38,0)") * F.col("w").cast("decimal(4,0)") > F.col("s").cast("decimal(19,0)") * F.lit(Decimal(most * weights)).cast("decimal(19,0)")
        done = over | (F.col("s") == 0)  # the share of the others only grows, so what was above stays above
    share = F.lit(float(left)) * F.col("w") / F.lit(float(max(weights, 1)))
    return sources.withColumn("target", F.when(done, (F.col("s") * most).cast("double")).otherwise(share))


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round the probabilities p in the given order; the index that stays fractional, or -1."""
    u = np.random.Generator(np.random.Philox(seed)).random(len(p))
    p, s, open_ = p.tolist(), sizes.tolist(), -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        down, up = min(p[i] * s[i], (1 - p[j]) * s[j]), min((1 - p[i]) * s[i], p[j] * s[j])  # words from i to j, or from j to i
        if u[j] * (down + up) < up:
            i_ends, j_ends = p[i] * s[i] <= (1 - p[j]) * s[j], p[i] * s[i] >= (1 - p[j]) * s[j]
            p[i], p[j] = 0.0 if i_ends else p[i] - down / s[i], 1.0 if j_ends else p[j] + down / s[j]
        else:
            i_ends, j_ends = (1 - p[i]) * s[i] <= p[j] * s[j], (1 - p[i]) * s[i] >= p[j] * s[j]
            p[i], p[j] = 1.0 if i_ends else p[i] + up / s[i], 0.0 if j_ends else p[j] - up / s[j]
        open_ = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return np.array(p), open_


def _round(level: int, width: int, last: bool):
    """Round one chunk; rows that are settled get p null, the one that isn't keeps its fraction and the next level's chunk."""

    def step(key, pdf):
        if "m" in pdf:
            pdf = pdf.loc[pdf.index.repeat(pdf["m"])]
        pdf = pdf.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        seed = (int(key[0]) << 40) ^ (level << 34) ^ int(key[1])
        p, left = pivot(pdf["doc_id"].to_numpy(), pdf["size"].to_numpy(), pdf["p"].to_numpy(np.float64), seed)
        if last and left >= 0:
            p[left] = float(np.random.Generator(np.random.Philox(seed + 1)).random() < p[left])
            left = -1
        settled = np.arange(len(p)) != left
        pdf["copies"] = pdf["copies"] + np.where(settled, np.rint(p), 0).astype(int)
        pdf["p"] = pd.Series(p).mask(settled)
        pdf["chunk"] = pdf["chunk"] // width
        return pdf[_COLS]

    return step


def _sources(sized: DataFrame, most: int, chunk: int) -> DataFrame:
    """One row for each source: key, source, src (its number), source_size, target, base and f (copies: whole part and fraction), n, chunks."""
    own = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("s"), F.count("*").alias("n"))
    ranked = checkpointed(number(own, "src", F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(c) for c in CYCLE]), (F.col("src") % len(CYCLE) + 1).cast("int"))
    filled = water_fill(ranked.withColumn("w", weight), most)
    rate = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0)
    return filled.select(
        "key", "source", "src", F.col("s").alias("source_size"), "target", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("f"), "n",
        F.ceil(F.col("n") / chunk).alias("chunks"))


def _dealt(sized: DataFrame, sources: DataFrame, total: int, chunk: int) -> DataFrame:
    """Rows with their source's number and rate, dealt to its chunks; equal rows travel as one with their number m, `chunk` at most."""
    same = sized.groupBy("key", "doc_id", "row", "size").agg(F.count("*").alias("m"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / chunk).cast("long") - 1))
    same = same.withColumn("piece", piece).withColumn("m", F.least(F.lit(chunk), F.col("m") - F.col("piece") * chunk).cast("int"))
    part = sources.select("key", "src", "base", "f", "n", "chunks")
    return spread_join(same, part, "key", "n", total).select(
        "doc_id", "row", "src", "size", F.pmod(F.xxhash64("doc_id", "size", "piece"), F.col("chunks")).alias("chunk"),
        F.when(F.col("size") > 0, F.col("base")).otherwise(0).alias("copies"), F.when(F.col("size") > 0, F.col("f")).otherwise(0.0).alias("p"), "m")


def mix(docs: DataFrame, most: int = 3, chunk: int = CHUNK, fan_in: int = FAN_IN, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row, and `row`, a binary column that also tells rows apart."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.lit(None).cast("binary")).alias("row"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))
    sized = checkpointed(sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    sources = checkpointed(_sources(sized, most, chunk))
    totals = sources.agg(F.sum("n"), F.max("chunks")).first()
    level = _dealt(sized, sources, totals[0] or 0, chunk)
    taken, k, widest = None, 0, totals[1] or 1
    while True:
        last = widest <= 1
        out = level.groupBy("src", "chunk").applyInPandas(_round(k, fan_in, last), _DDL)
        settled = out.filter("p is null").select("doc_id", "row", "src", "size", "copies")
        taken = settled if taken is None else taken.unionByName(settled)
        if last:
            break
        level, widest, k = out.filter("p is not null"), -(-widest // fan_in), k + 1
    facts = sources.select("src", "source", "source_size", "target", "n")
    return spread_join(taken, facts, "src", "n", totals[0] or 0).select(
        "doc_id", "row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("copies", "row")


def repeat(docs: DataFrame, most: int = 3) -> DataFrame:
    """Every document as many times as the mix takes it; same columns.

    A hash of all columns names a row; of rows that are equal in all of them one stands for all and takes their copies.
    """
    own = renamed(docs, "doc_id", "text", "source")
    others = [c for c in own.columns if c != "text"]
    own = own.withColumn("__row", F.unhex(F.md5(F.concat(F.coalesce(F.md5(F.col("text").cast("string")), F.lit("-")), F.to_json(F.struct(*others))))))
    taken = mix(own, most, row="__row").groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    one = own.select(F.col("__row").alias("row"), F.struct(*[c for c in own.columns if c != "__row"]).alias("whole")).dropDuplicates(["row"])
    both = one.join(taken.hint("shuffle_merge"), "row")
    return both.select("whole", F.explode(F.sequence(F.lit(1), "copies"))).select("whole.*").toDF(*docs.columns)
