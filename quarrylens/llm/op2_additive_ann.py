"""Approximate nearest neighbours by additive quantisation.

Vectors are written as a norm and a sum of code words from `stages` full-dimensional codebooks: residual codebooks by
k-means, refitted together by least squares, and codes by beam search. Queries meet the codes in blocks: a look-up
table of inner products per query scores a block of codes, and the original vectors of the best `shortlist` are ranked
exactly, in double precision. Each code keeps the length of what it leaves out, which bounds the error of its score: the
other rows of the block that could still belong to the k nearest are ranked exactly too. So no row is missed, however
badly the codes fit the vectors; a bad fit costs time only.

Training takes at most `sample` vectors, smallest hashes first; every vector is indexed. The stated queries meet all
rows, in blocks of bounded size joined on the pair of block numbers.

Vectors are scaled by their largest component before norms are taken, and scores are kept in double precision, so that
very large and very small components neither overflow nor vanish. Rows are numbered in the written copy that all steps read.

Defined results: vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite
components take no part, nor do rows without vec_id; rows with one vec_id are rows of their own, as queries (each has
its own ranks) and as candidates of each other; equal scores go to the smaller vec_id; a query with fewer candidates
than `k` gets them all; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table

STAGES, WORDS, BEAM = 20, 256, 8
SAMPLE = 8_192
MERGE = 64
SHORTLIST = 100
CODE_BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Bytes of vectors in a block: long vectors make blocks of fewer rows.
BLOCK_BYTES = 4 << 20
SEED = 5


@dataclass
class Codebooks:
    words: np.ndarray  # (stages, words, dim) float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search over the stages: (rows, stages) uint8. Each beam carries its residual vector."""
        m, k, dim = self.words.shape
        out = np.empty((len(x), m), np.uint8)
        sq = (self.words**2).sum(axis=2)
        for a in range(0, len(x), 256):
            rest = x[a : a + 256, None]
            n = len(rest)
            codes = np.zeros((n, 1, 0), np.uint8)
            for j in range(m):
                cost = (sq[j] - 2 * (rest.reshape(-1, dim) @ self.words[j].T)).reshape(n, -1, k) + (rest**2).sum(axis=2)[:, :, None]
                flat = cost.reshape(n, -1)
                width = min(beam, flat.shape[1]) if j < m - 1 else 1
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                old, new = best // k, best % k
                rest = np.take_along_axis(rest, old[:, :, None], 1) - self.words[j][new]
                codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), new[:, :, None].astype(np.uint8)], axis=2)
            out[a : a + 256] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(len(self.words)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(stages, words, queries) inner products."""
        return np.ascontiguousarray(np.einsum("qd,mkd->mkq", q, self.words, optimize=True))

    def slack(self) -> float:
        """Most that single precision can move a score of `tables` for a query of length one, twice over."""
        m, _, dim = self.words.shape
        longest = np.linalg.norm(self.words.astype(np.float64), axis=2).max(axis=1).sum()
        return float(2 * (dim + m + 2) * np.finfo(np.float32).eps * (1 + longest))


def train(x: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 1, seed: int = SEED) -> Codebooks:
    """Residual k-means per stage, then `rounds` of beam-search coding and refitting of all codebooks."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x) // 8))
    books, rest = [], x.copy()
    for _ in range(stages):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(8):
            near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            full = n > 0
            c[full] = sums[full] / n[full, None]
        near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
        rest -= c[near]
        books.append(c)
    out = Codebooks(np.stack(books))
    for _ in range(rounds):
        codes = out.encode(x)
        rest = x - out.decode(codes)
        for _ in range(4):  # least squares, one codebook at a time
            for j in range(stages):
                n = np.bincount(codes[:, j], minlength=words)
                sums = np.zeros_like(out.words[j])
                np.add.at(sums, codes[:, j], rest)
                step = sums / np.maximum(n, 1)[:, None]
                out.words[j] += step
                rest -= step[codes[:, j]]
    return out


def top(scores: np.ndarray, most: int) -> np.ndarray:
    """Rows of the `most` largest scores, equal ones by smaller row."""
    if len(scores) <= most:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: most - len(above)]])


def _usable(vectors: DataFrame) -> DataFrame:
    """row (a number), vec_id, v of the vectors that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return checkpointed(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the norms (at most the largest double); each is scaled by its largest component first."""
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(over="ignore"):
        return x / norm[:, None], np.minimum(norm * most, np.finfo(np.float64).max)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with q in double precision, summed in the order of the components."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(x.astype(np.float64) * q, axis=1)[:, -1] + 0.0


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of rows (vec_id, row), largest first, of equals those with smaller ids."""
    key = np.where(np.isnan(score), np.inf, score)
    if len(key) > 4 * k:
        keep = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
        ids, score, key = ids[keep], score[keep], key[keep]
    order = np.lexsort((ids[:, 1], ids[:, 0], -key))[:k]
    return ids[order], score[order]


def search(near: np.ndarray, error: np.ndarray, norms: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, length: float, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block's rows. near: scores by codes for the query of length one, at most `error` off (both for rows of length one)."""
    with np.errstate(over="ignore", invalid="ignore"):
        first = np.zeros(len(near), bool)
        first[top(np.nan_to_num(near * norms), shortlist)] = True
        at = np.flatnonzero(first)
        exact = products(x[at], q)
        if len(at) >= k:
            least = np.partition(exact, len(exact) - k)[len(exact) - k]
            most = (near + error) * norms * length
            rest = np.flatnonzero(~first & ~(most < least))  # whatever is not known to be farther
            for a in range(0, len(rest), 4096):
                at = np.concatenate([at, rest[a : a + 4096]])
                exact = np.concatenate([exact, products(x[rest[a : a + 4096]], q)])
    return best_of(ids[at], exact, k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shortlist: int = SHORTLIST, sample: int = SAMPLE, code_block: int = CODE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    ddl = "query_id long, rank int, vec_id long, score double"
    rows = _usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], ddl)
    dim, n = sizes[0].d, sizes[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    taught = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").limit(sample).select("v").toPandas()["v"]  # `sample` rows at most
    x = np.stack(taught.to_list()).astype(np.float64)
    shared = spark.sparkContext.broadcast(train(unit(x)[0]))  # stages * words * dim numbers
    stored = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    shortlist = max(shortlist, k)
    code_block = max(1, min(code_block, BLOCK_BYTES // (dim * np.dtype(stored).itemsize)))
    query_block = max(1, min(query_block, BLOCK_BYTES // (dim * 8)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = shared.value.slack()
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x, norm = unit(v.astype(np.float64))
            codes = shared.value.encode(x.astype(np.float32))
            error = np.linalg.norm(x - shared.value.decode(codes), axis=1) + slack
            blobs = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, v.astype(stored))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), *blobs, pa.array(norm), pa.array(error)], ["row", "vec_id", "code", "x", "norm", "error"])

    def pack_codes(key, pdf):
        pdf = pdf.sort_values(["vec_id", "row"])
        numbers = {c: [pdf[c].to_numpy(np.float64).tobytes()] for c in ("norm", "error")}
        return pd.DataFrame({"cb": [key[0]], "ids": [_pairs(pdf)], "codes": [b"".join(pdf["code"])], "x": [b"".join(pdf["x"])], **numbers})

    def pack_queries(key, pdf):
        q = np.stack(pdf["v"].to_list()).astype(np.float64)
        return pd.DataFrame({"qb": [key[0]], "query_ids": [_pairs(pdf)], "queries": [q.tobytes()]})

    def pack_found(cb: int, qb: int, lists: dict) -> pd.DataFrame:
        sizes = np.array([len(v) for v, _ in lists.values()], np.int64).tobytes()
        ids, score = (b"".join(x[i].tobytes() for x in lists.values()) for i in range(2))
        return pd.DataFrame({"qb": [qb], "cb": [cb], "query_ids": [np.array(list(lists), np.int64).tobytes()], "sizes": [sizes], "ids": [ids], "score": [score]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, norms, error = np.frombuffer(r.ids, np.int64).reshape(-1, 2), np.frombuffer(r.norm, np.float64), np.frombuffer(r.error, np.float64)
                codes = np.ascontiguousarray(np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1).T)
                x = np.frombuffer(r.x, stored).reshape(-1, dim)
                query_ids, q = np.frombuffer(r.query_ids, np.int64).reshape(-1, 2), np.frombuffer(r.queries, np.float64).reshape(-1, dim)
                ones, lengths = unit(q)
                lists = {}
                for a in range(0, len(q), 64):
                    lut = shared.value.tables(ones[a : a + 64].astype(np.float32))
                    s = lut[0].take(codes[0], axis=0)
                    for j in range(1, len(lut)):
                        s += lut[j].take(codes[j], axis=0)
                    s = np.ascontiguousarray(s.T, np.float64)
                    for i, own in enumerate(query_ids[a : a + 64]):
                        other = np.flatnonzero(ids[:, 1] != own[1])
                        part = (s[i], error, norms, ids, x) if len(other) == len(ids) else (s[i][other], error[other], norms[other], ids[other], x[other])
                        lists[tuple(own.tolist())] = search(*part, q[a + i], lengths[a + i], k, shortlist)
                yield pack_found(r.cb, r.qb, lists)

    def merged(key, pdf):
        """Best of the lists that a query got from several blocks of codes."""
        lists: dict = {}
        for r in pdf.sort_values("cb").itertuples(index=False):
            ends = np.cumsum(np.frombuffer(r.sizes, np.int64))
            parts = zip(np.split(np.frombuffer(r.ids, np.int64).reshape(-1, 2), ends[:-1]), np.split(np.frombuffer(r.score, np.float64), ends[:-1]), strict=True)
            for own, (v, s) in zip(map(tuple, np.frombuffer(r.query_ids, np.int64).reshape(-1, 2).tolist()), parts, strict=True):
                if own in lists:
                    v, s = best_of(np.concatenate([lists[own][0], v]), np.concatenate([lists[own][1], s]), k)
                lists[own] = v, s
        return pack_found(int(key[1]), int(key[0]), lists)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, np.int64)
                own = np.repeat(np.frombuffer(r.query_ids, np.int64)[::2], sizes)
                rank = np.concatenate([np.arange(1, m + 1) for m in sizes.tolist()]).astype(np.int32)
                yield pd.DataFrame({"query_id": own, "rank": rank, "vec_id": np.frombuffer(r.ids, np.int64)[::2], "score": np.frombuffer(r.score, np.float64)})

    c_blocks, q_blocks = max(1, -(-n // code_block)), max(1, -(-n // (every * query_block)))
    number = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    coded = small_batches(rows).mapInArrow(encode, "row long, vec_id long, code binary, x binary, norm double, error double")
    codes = coded.groupBy(number(c_blocks).alias("cb")).applyInPandas(pack_codes, "cb int, ids binary, codes binary, x binary, norm binary, error binary")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(number(q_blocks).alias("qb")).applyInPandas(pack_queries, "qb int, query_ids binary, queries binary")
    codes = codes.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    queries = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    lists = "qb int, cb int, query_ids binary, sizes binary, ids binary, score binary"
    both = codes.join(queries, ["cb", "qb"]).select("cb", "qb", "ids", "codes", "x", "norm", "error", "query_ids", "queries")
    found = both.mapInPandas(scan, lists)
    while c_blocks > 1:  # a tree: no task holds the lists of more than MERGE blocks
        c_blocks = -(-c_blocks // MERGE)
        found = found.groupBy("qb", F.expr(f"cb div {MERGE}").cast("int").alias("to")).applyInPandas(merged, lists)
    return found.mapInPandas(unpack, ddl)


def _pairs(pdf: pd.DataFrame) -> bytes:
    return np.ascontiguousarray(pdf[["vec_id", "row"]].to_numpy(np.int64)).tobytes()


def op2_additive_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
