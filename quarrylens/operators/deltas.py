"""Upkeep after a save by signed rows: what a change takes away has sign -1, what it adds +1.

Signed rows flow through the same operators as the tables themselves: a filter or projection keeps the sign, a join
multiplies signs, an aggregate sums them. So only keys that a change touches are joined and summed again; the state of all others
stays as it is. A row with sign n counts n times; a state table without a sign column has each row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "sign"


def _signed(df: DataFrame) -> DataFrame:
    return df if SIGN in df.columns else df.withColumn(SIGN, F.lit(1).cast("long"))


def net(signed: DataFrame) -> DataFrame:
    """Equal rows as one, with the sum of their signs; those that cancel out are gone."""
    columns = [c for c in signed.columns if c != SIGN]
    return signed.groupBy(*columns).agg(F.sum(SIGN).alias(SIGN)).filter(F.col(SIGN) != 0).select(*columns, SIGN)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that turn the old rows into the new ones (columns of any type that groups)."""
    return net(_signed(new).unionByName(_signed(old).withColumn(SIGN, -F.col(SIGN))))


def of_changed(old: DataFrame, new: DataFrame, changed: DataFrame, *key: str) -> DataFrame:
    """As difference, of rows whose key is in `changed`: all others are neither compared nor shuffled beyond a semi-join."""
    pick = lambda df: df.join(changed.select(*key).distinct(), list(key), "left_semi")
    return difference(pick(old), pick(new))


def join(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Signed rows of the join of two tables after both have changed: d_left with the old right, and the new left with d_right.

    left, right: the old states. Only rows that meet a changed key on the other side are read beyond the join's filter.
    """
    on = list(on)

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        both = _signed(a).join(_signed(b).withColumnRenamed(SIGN, "__s"), on)
        return both.withColumn(SIGN, F.col(SIGN) * F.col("__s")).drop("__s")

    near = left.join(d_right.select(*on).distinct(), on, "left_semi")
    return net(product(d_left, right).unionByName(product(_signed(near).unionByName(_signed(d_left)), d_right)))


def sums(rows: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    """n and the measures of each key, from plain or signed rows."""
    rows = _signed(rows)
    return rows.groupBy(*by).agg(F.sum(SIGN).alias("n"), *[F.sum(m * F.col(SIGN)).alias(k) for k, m in measures.items()])


def touched(state: DataFrame, d_sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """New values of the keys that a change touches; n is 0 where a key is gone. state, d_sums: from sums."""
    by = list(by)
    before = state.join(d_sums.select(*by), by, "left_semi")
    values = [c for c in d_sums.columns if c not in by]
    return before.select(*by, *values).unionByName(d_sums.select(*by, *values)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in values])


def upsert(state: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state with the touched keys' new values in place of their old ones."""
    rest = state.join(new.select(*by), list(by), "left_anti")
    return rest.unionByName(new.filter("n <> 0").select(*state.columns))


class ImportState:
    """Edges, degrees and module sums of a project, kept up under changes of files.

    imports: (src, module) of every import; names: (module, dst), the file each module name stands for; homes: (file_id,
    home), the module each file belongs to. `after` gives the state after signed changes of the first two (homes of files
    that come or go included in `homes`).
    """

    def __init__(self, imports: DataFrame, names: DataFrame, homes: DataFrame, edges: DataFrame | None = None, out: DataFrame | None = None, into: DataFrame | None = None, between: DataFrame | None = None):
        self.imports, self.names, self.homes = imports, names, homes
        self.edges = edges if edges is not None else net(_signed(imports.join(names, "module").select("src", "dst").filter("src <> dst")))
        self.out = out if out is not None else sums(self.edges, ["src"])
        self.into = into if into is not None else sums(self.edges, ["dst"])
        self.between = between if between is not None else sums(self.housed(self.edges), ["from_home", "to_home"])

    def housed(self, edges: DataFrame) -> DataFrame:
        side = lambda k, name: self.homes.select(F.col("file_id").alias(k), F.col("home").alias(name))
        return edges.join(side("src", "from_home"), "src").join(side("dst", "to_home"), "dst")

    def after(self, d_imports: DataFrame, d_names: DataFrame) -> ImportState:
        d = join(self.imports, d_imports, self.names, d_names, ["module"]).filter("src <> dst").select("src", "dst", SIGN)
        d = net(d)
        out, into, between = (touched(s, sums(rows, by), by) for s, rows, by in ((self.out, d, ["src"]), (self.into, d, ["dst"]), (self.between, self.housed(d), ["from_home", "to_home"])))
        return ImportState(
            net(_signed(self.imports).unionByName(d_imports)), net(_signed(self.names).unionByName(d_names)), self.homes, net(self.edges.unionByName(d)),
            upsert(self.out, out, ["src"]), upsert(self.into, into, ["dst"]), upsert(self.between, between, ["from_home", "to_home"]),
        )
