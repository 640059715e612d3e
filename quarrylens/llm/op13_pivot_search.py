"""Exact top-k by largest integer inner product, with elimination by a pivot table.

Components become floor(1024 * x). The distances of every vector to the pivots (the origin and `pivots` vectors far from
each other in a sample) are computed once. By the triangle inequality the largest difference of two vectors' distances to
a pivot bounds their own distance from below, and so, with their norms, their inner product from above.

Rows lie in the cell of their nearest pivot, cells in blocks of about `block` rows; queries likewise. (1) A query meets a block
of its own cell: its k-th best score there is its threshold. (2) Pairs of a query block and a row block, of which only
the ranges of pivot distances and norms travel, stay if their bound reaches the least threshold. (3) In the pairs
that stay, each query takes a block's candidates in the order of their bounds, and stops when the next bound is below its k-th
best score so far. A block is sent once for each QUERY_GROUP query blocks, never split from its table. Results are exact whatever the
pivots are; how much is eliminated depends on the data.

Sums are taken in double precision where they are exact (below 2^53), else in whole numbers of any length.

Defined results: vectors that are null, empty, of another length than the most frequent one, or hold null or
non-finite components take no part, nor do rows without vec_id; zero vectors do; rows with one vec_id are rows of their own,
as queries (each has its own ranks) and as candidates of each other; scores outside a long count as its least or largest
value; equal scores go to the smaller vec_id; a query with fewer candidates than `k` gets them all; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, table

SCALE = 1024
PIVOTS, SAMPLE = 32, 4_096
BLOCK, QUERY_BLOCK, QUERY_GROUP = 8_192, 512, 16
PAIRED = 64
STEP = 256
SEED = 13
EXACT = 2.0**53
LEAST, LARGEST = -(2**63), 2**63 - 1
NONE = -np.inf


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) in double precision; exact but where it leaves the doubles' range."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def _long(c: float) -> int:
    return int(c) * SCALE if abs(c) >= EXACT else math.floor(c * SCALE)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with many (original components), as longs."""
    qi, xi = whole(q), whole(x)
    most = np.abs(xi).max(axis=1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        plain = np.abs(qi).max(initial=0.0) * most * len(q) < EXACT
        out = np.zeros(len(x), np.int64)
        out[plain] = (xi[plain] @ qi).astype(np.int64)
    if not plain.all():
        own = [_long(c) for c in q.tolist()]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = min(max(sum(a * _long(b) for a, b in zip(own, x[i].tolist(), strict=True)), LEAST), LARGEST)
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances of scaled vectors; too large ones are infinite or not a number."""
    xi = whole(x)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((xi - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def upper(dq: np.ndarray, dx: np.ndarray, nq, nx) -> np.ndarray:
    """Upper bounds of inner products by pivot distances and squared norms, with room for rounding; unknown ones are infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.abs(dq - dx).max(axis=-1)
        b = (nq + nx - least**2) / 2 + 1e-9 * (nq + nx) + 1
    return np.where(np.isfinite(b), b, np.inf)


def gaps(qlo: np.ndarray, qhi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least difference between values of two ranges, for each pivot."""
    with np.errstate(invalid="ignore"):
        return np.maximum(np.maximum(qlo - hi, lo - qhi), 0)


def choose(x: np.ndarray, most: int) -> np.ndarray:
    """The origin, then the sample's vectors that are farthest from the ones chosen."""
    xi = whole(x)
    xi = xi[np.isfinite(xi).all(axis=1) & (np.abs(xi).max(axis=1) < 1e100)]
    out = [np.zeros(x.shape[1])]
    near = (xi**2).sum(axis=1)
    while len(out) <= most and len(near) and near.max() > 0:
        out.append(xi[int(near.argmax())])
        near = np.minimum(near, ((xi - out[-1]) ** 2).sum(axis=1))
    return np.stack(out)


def best(score: np.ndarray, vec: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: largest score, then smaller vec_id, then smaller row."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
        return at[np.lexsort((row[at], vec[at], -score[at].astype(object) if score[at].min(initial=0) == LEAST else -score[at]))[:k]]
    return np.lexsort((row, vec, -score.astype(object) if score.min(initial=0) == LEAST else -score))[:k]


class Block:
    """Vectors of a packed block: rows, ids, original components, pivot distances, squared norms."""

    def __init__(self, r, dim: int, pivots: int):
        self.row, self.vec = np.frombuffer(r.row, np.int64), np.frombuffer(r.vec, np.int64)
        self.x = np.frombuffer(r.x, np.float64).reshape(-1, dim)
        self.d = np.frombuffer(r.d, np.float64).reshape(-1, pivots)
        with np.errstate(over="ignore"):
            self.norm = self.d[:, 0] ** 2  # the first pivot is the origin
        self.lo, self.hi = self.d.min(axis=0), self.d.max(axis=0)  # not a number, and so no bound, if any is


def search_block(q: Block, i: int, b: Block, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and places in the block of the k best candidates of query i that reach `least`, and how many were evaluated."""
    none = np.zeros(0, np.int64)
    gap = gaps(q.d[i], q.d[i], b.lo, b.hi)
    if upper(gap, 0.0, q.norm[i], b.norm.max()) < least:
        return none, none, 0
    bound = upper(q.d[i], b.d, q.norm[i], b.norm)
    bound[b.row == q.row[i]] = NONE
    order = np.argsort(-bound, kind="stable")
    kept, at, done = none, none, 0
    while done < len(order) and bound[order[done]] >= least and bound[order[done]] != NONE:
        new = order[done : done + STEP]
        new = new[bound[new] != NONE]
        kept, at = np.concatenate([kept, scores(q.x[i], b.x[new])]), np.concatenate([at, new])
        keep = best(kept, b.vec[at], b.row[at], k)
        kept, at, done = kept[keep], at[keep], done + STEP
        if len(kept) == k:
            least = max(least, float(kept[-1]) * (1 - 1e-9 * np.sign(kept[-1])))
    return kept, at, min(done, len(order))


def _usable(vectors: DataFrame) -> DataFrame:
    """row (a number), vec_id, v of the vectors that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return checkpointed(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    rows = _usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = sizes[0].d
    rows = rows.filter(F.size("v") == dim)
    taught = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").limit(SAMPLE).select("v").toPandas()["v"]  # SAMPLE rows at most
    points = choose(np.stack(taught.to_list()), pivots)
    shared, width = spark.sparkContext.broadcast(points), len(points)  # (pivots + 1) * dim numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            d = distances(x, shared.value)
            cell = np.where(np.isfinite(d), d, np.inf).argmin(axis=1)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, d)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(cell.astype(np.int32)), *packed], ["row", "vec_id", "cell", "x", "d"])

    packed = "cell int, part int, row binary, vec binary, x binary, d binary"

    def pack(key, pdf):
        pdf = pdf.sort_values(["vec_id", "row"])
        ids = [pdf[c].to_numpy(np.int64).tobytes() for c in ("row", "vec_id")]
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "row": [ids[0]], "vec": [ids[1]], "x": [b"".join(pdf["x"])], "d": [b"".join(pdf["d"])]})

    index = checkpointed(rows.mapInArrow(measure, "row long, vec_id long, cell int, x binary, d binary"))
    asked = F.col("vec_id") % every == 0
    per_cell = index.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()  # a row for each pivot
    number = lambda n, size: F.element_at(F.create_map(*[F.lit(v) for r in per_cell for v in (r.cell, max(1, -(-r[n] // size)))]), F.col("cell"))
    part = lambda n, size: F.pmod(F.xxhash64("row"), number(n, size)).cast("int").alias("part")
    blocks = checkpointed(index.groupBy("cell", part("n", block)).applyInPandas(pack, packed))
    queries = index.filter(asked).groupBy("cell", part("q", query_block)).applyInPandas(pack, packed)

    def seed(left, right):
        """Thresholds of query blocks from one row block of their cell."""
        out = []
        b = next((Block(r, dim, width) for r in left.itertuples(index=False)), None)
        for r in right.itertuples(index=False):
            q = Block(r, dim, width)
            least = np.full(len(q.row), NONE)
            for i in range(len(q.row)) if b else ():
                found = search_block(q, i, b, k, NONE)[0]
                if len(found) == k:
                    least[i] = float(found[-1]) * (1 - 1e-9 * np.sign(found[-1]))
            out.append((r.cell, r.part, r.row, r.vec, r.x, r.d, least.tobytes()))
        return pd.DataFrame(out, columns=["cell", "part", "row", "vec", "x", "d", "least"])

    home = F.pmod(F.col("part"), number("n", block)).cast("int").alias("home")
    queries = checkpointed(blocks.groupBy("cell", F.col("part").alias("home")).cogroup(queries.groupBy("cell", home)).applyInPandas(seed, f"{packed}, least binary"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest pivot distances, largest squared norm and least threshold of blocks."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                d = np.frombuffer(r["d"], np.float64).reshape(-1, width)
                with np.errstate(over="ignore"):
                    norm = float(d[:, 0].max() ** 2)
                least = float(np.frombuffer(r["least"], np.float64).min()) if r.get("least") else NONE
                out.append({"cell": r["cell"], "part": r["part"], "lo": d.min(axis=0).tolist(), "hi": d.max(axis=0).tolist(), "norm": norm, "least": least})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("norm", pa.float64()), ("least", pa.float64())]))

    side = "cell int, part int, lo array<double>, hi array<double>, norm double, least double"
    row_side = blocks.select("cell", "part", "d").mapInArrow(ranges, side)
    query_side = queries.select("cell", "part", "d", "least").mapInArrow(ranges, side)
    # a query block meets the ranges of all row blocks, PAIRED of them in a task; only ranges travel
    spread = max(1, sum(-(-r.n // block) for r in per_cell) // PAIRED)
    row_side = row_side.drop("least").withColumn("spread", F.pmod(F.xxhash64("cell", "part"), F.lit(spread)).cast("int"))
    query_side = query_side.toDF("qcell", "qpart", "qlo", "qhi", "qnorm", "qleast").withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            qlo, qhi, lo, hi = (np.array(pdf[c].to_list()).reshape(len(pdf), -1) for c in ("qlo", "qhi", "lo", "hi"))
            bound = upper(gaps(qlo, qhi, lo, hi), 0.0, pdf["qnorm"].to_numpy(), pdf["norm"].to_numpy())
            yield pdf.loc[bound >= pdf["qleast"].to_numpy(), ["qcell", "qpart", "cell", "part"]]

    pairs = query_side.join(row_side, "spread").mapInPandas(reachable, "qcell int, qpart int, cell int, part int")
    pairs = checkpointed(pairs.withColumn("group", F.expr(f"qpart div {group}").cast("int")))
    key = ["cell", "part", "qcell", "group"]
    sent = pairs.join(queries.withColumnsRenamed({"cell": "qcell", "part": "qpart"}), ["qcell", "qpart"])
    wanted = blocks.join(pairs.select(*[F.col(c).alias(c) for c in key]).distinct(), ["cell", "part"])

    def scan(left, right):
        out = []
        for r in left.itertuples(index=False):  # one block
            b = Block(r, dim, width)
            for s in right.itertuples(index=False):
                q, least = Block(s, dim, width), np.frombuffer(s.least, np.float64)
                for i in range(len(q.row)):
                    found, at, _ = search_block(q, i, b, k, least[i])
                    if len(found):
                        out.append(pd.DataFrame({"query": q.row[i], "query_id": q.vec[i], "row": b.row[at], "vec_id": b.vec[at], "score": found}))
        ddl = {"query": "int64", "query_id": "int64", "row": "int64", "vec_id": "int64", "score": "int64"}
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in ddl.items()})

    found = wanted.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(scan, "query long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_pivot_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def oracle() -> str:
    return """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, e.v) DESC, e.vec_id) AS rank
 FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""
