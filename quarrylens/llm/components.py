"""Connected components by alternating large-star and small-star steps, and joins whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts_of


def spread_join(many: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """many ⋈ one on `key`, unique in `one`, whose column `n` counts its rows in `many` (`total` in all).

    A key with over half a partition's share of the rows is split by a hash of the row into parts of that size, and
    its row of `one` is repeated for each part. At most 2 * partitions keys are so hot: these are broadcast.
    """
    most = max(256, total // (2 * parts_of(many)))
    hot = one.filter(F.col(n) > most).select(F.col(key).alias("__hot"), F.ceil(F.col(n) / most).cast("int").alias("__parts"))
    salt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns if c != key]), F.col("__parts"))).cast("int")
    left = many.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot", "__parts")
    salts = F.sequence(F.lit(0), F.when(F.col(n) > most, F.ceil(F.col(n) / most).cast("int") - 1).otherwise(0))
    return left.join(one.withColumn("__salt", F.explode(salts)), [key, "__salt"]).drop("__salt")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang the larger (large) or the smaller neighbours of each node, and itself, on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = spread_join(both, least, "a", "n", total)
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in `edges` (a, b: of one orderable type)."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        before = state
        now = checkpointed(_star(_star(now, True, 2 * state[0]), False, state[0]))
        state = _state(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
