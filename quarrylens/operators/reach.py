"""Reach from many starts at once, with starts packed into bit sets.

Starts are numbered. Neighbouring ones make a ball: Spark finds which files each ball reaches (a row for each ball and file,
not for each start and file), and their imports are sent to the ball's task once. There the starts go on as bits, LANES at a
time, and pairs or counts leave as they are found. So no level is shuffled for each start.

Balls that reach more than HELD imports are taken apart by `levels`. LANES of their starts make a block. A row (file_id, block,
depth, w0 .. w15) says which starts of a block reach the file first at that depth, one bit for each start. A level is one join
with the edges and a bit_or for each (file, block), combined before the shuffle; what was seen before is taken off by AND NOT.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .entities import number

WORD, WORDS = 64, 16
LANES = WORD * WORDS
#: Rows of bits that one task unpacks at a time: so many times LANES pairs at most.
UNPACKED = 4_096
#: Levels after which their bits are put together and written: plans stay short on long ways.
MERGED = 8
#: Files over which the starts of a ball lie, on average, and imports that a ball's task holds at most.
BALL, HELD = 8_192, 2_000_000
#: Files whose starts are sent at a time.
SENT = 16_384
#: Imports of one file: n distinct ones, of which first is the least; rest: see _packed.
PACKED = "src long, n long, first long, rest binary"
WORD_COLUMNS = _W = [f"w{i}" for i in range(WORDS)]


def _any(columns: list[str]) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.col(c) for c in columns]) != 0


def _or(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id", "block").agg(*[F.bit_or(c).alias(c) for c in _W])


def start_blocks(starts: DataFrame) -> DataFrame:
    """file_id, block and lane (0 to LANES - 1) of each distinct start."""
    ids = number(starts.select(F.col("file_id").cast("long").alias("file_id")).filter("file_id is not null").distinct(), "no", F.col("file_id"))
    return written(ids.select("file_id", F.expr(f"no div {LANES}").alias("block"), F.expr(f"cast(no % {LANES} as int)").alias("lane")))


def levels(edges: DataFrame, lanes: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """Bits of files first reached at depth 0, 1, ...; until max_depth or until nothing is new. lanes: from start_blocks."""
    edges = written(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst").distinct())
    bit = [F.expr(f"if(lane div {WORD} = {i}, shiftleft(1L, lane % {WORD}), 0L)").alias(c) for i, c in enumerate(_W)]
    out = [written(lanes.select("file_id", "block", *bit))]
    seen = out[0]
    while max_depth is None or len(out) <= max_depth:
        step = _or(out[-1].join(edges, F.col("file_id") == F.col("src")).select(F.col("dst").alias("file_id"), "block", *_W))
        before = _or(seen).withColumnsRenamed({c: f"s_{c}" for c in _W})
        fresh = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"s_{c}", F.lit(0)))).alias(c) for c in _W]
        # filtered when written: the planner's constraints double with each of the words that a condition goes through
        new = written(step.join(before, ["file_id", "block"], "left").select("file_id", "block", *fresh)).filter(_any(_W))
        if new.isEmpty():
            break
        out.append(new)
        seen = seen.unionByName(new)
        if len(out) % MERGED == 0:
            seen = written(_or(seen))
    return out


def merged(found: list[DataFrame]) -> DataFrame:
    """Bits of all depths together."""
    return _or(functools.reduce(DataFrame.unionByName, found))


def pairs(found: list[DataFrame], lanes: DataFrame) -> DataFrame:
    """(start, file_id, depth) of the bits; no task holds more than UNPACKED rows of a block."""
    rows = functools.reduce(DataFrame.unionByName, [bits.withColumn("depth", F.lit(d)) for d, bits in enumerate(found)])
    most = rows.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // UNPACKED))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("file_id", "depth"), F.lit(salts)).cast("int"))
    ids = lanes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("lane", "file_id"))).alias("starts"))  # LANES at most
    ids = ids.select(F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("starts.file_id").alias("starts"))

    def unpack(left, right):
        if not len(left):
            return pd.DataFrame({"start": pd.Series(dtype="int64"), "file_id": pd.Series(dtype="int64"), "depth": pd.Series(dtype="int32")})
        words = np.ascontiguousarray(left[_W].to_numpy(np.int64)).astype("<i8")
        row, lane = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(len(left), -1), axis=1, bitorder="little"))
        starts = np.asarray(right["starts"].iloc[0], np.int64)
        return pd.DataFrame({"start": starts[lane], "file_id": left["file_id"].to_numpy(np.int64)[row], "depth": left["depth"].to_numpy(np.int32)[row]})

    return rows.groupBy("block", "salt").cogroup(ids.groupBy("of", "salt")).applyInPandas(unpack, "start long, file_id long, depth int")


def imports_of(edges: DataFrame) -> DataFrame:
    """src, n, dst (n distinct files): the imports of each file, in rows of a batch at most."""
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            src, dst = batch["src"].to_numpy(), batch["dst"].to_numpy()
            if not len(src):
                continue
            new = np.r_[before != (src[0], dst[0]), (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
            before = (src[-1], dst[-1])
            src, dst = src[new], dst[new]
            at = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
            ends = np.r_[at, len(src)]
            yield pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(dst))], names=["src", "n", "dst"])

    return written(plain.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(packed, "src long, n long, dst array<long>"))


def _packed(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    """PACKED of pairs: sorted, equal ones once. rest has the steps from one dst to the next, all of a row in as few bytes as its largest needs."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])] if len(src) else np.zeros(0, bool)
    src, dst = src[new], dst[new]
    at = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
    n, steps = np.diff(np.r_[at, len(src)]), np.diff(dst.view(np.uint64), prepend=np.uint64(0))
    steps[at] = 0
    most = np.maximum.reduceat(steps, at) if len(at) else steps
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    data = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[np.arange(8) < np.repeat(width, n)[:, None]]
    ends = np.cumsum(np.r_[0, n * width]).astype(np.int32)
    rest = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array(n), pa.array(dst[at]), rest], names=["src", "n", "first", "rest"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The row of the batch and dst, of each pair."""
    n, data = batch["n"].to_numpy(), np.frombuffer(b"".join(batch["rest"].to_pylist()), np.uint8)
    width = pc.binary_length(batch["rest"]).to_numpy() // n
    steps = np.zeros((int(n.sum()), 8), np.uint8)
    steps[np.arange(8) < np.repeat(width, n)[:, None]] = data
    way = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
    base = batch["first"].to_numpy().view(np.uint64) - (way[np.cumsum(n) - n] if len(n) else way)
    return np.repeat(np.arange(len(n)), n), (way + np.repeat(base, n)).view(np.int64)


def packed_imports(edges: DataFrame | list[DataFrame]) -> DataFrame:
    """PACKED of all edges, one row for each src and batch. Edges that come in a list are shuffled one after the other, and what is packed once more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed(batch["src"].to_numpy(), batch["dst"].to_numpy())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, dst = _unpacked(batch)
            yield _packed(batch["src"].to_numpy()[row], dst)

    rounds = edges if isinstance(edges, list) else [edges]
    plain = [e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst") for e in rounds]
    out = [written(e.repartition("src").sortWithinPartitions("src").mapInArrow(pack, PACKED)) for e in plain]
    if len(out) == 1:
        return out[0]
    return written(functools.reduce(DataFrame.unionByName, out).repartition("src").sortWithinPartitions("src").mapInArrow(again, PACKED))


def _pairs_of(imports: DataFrame, key: str) -> DataFrame:
    """key and file_id, of all imports in rows of key and PACKED; equal ones of a batch once."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, dst = _unpacked(batch)
            of = batch[key].to_numpy()[row]
            order = np.lexsort((dst, of))
            of, dst = of[order], dst[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (dst[1:] != dst[:-1])] if len(of) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(of[new]), pa.array(dst[new])], names=[key, "file_id"])

    return imports.select(key, "n", "first", "rest").mapInArrow(unpack, f"{key} long, file_id long")


def _members(imports: DataFrame, starts: DataFrame, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """(ball, file_id, start) of files whose imports a ball needs, and the balls that would hold more than HELD. starts: ball, file_id."""
    known = frontier = written(starts.withColumn("start", F.lit(True)))
    depth, over, size = 0, None, None
    while True:
        more = frontier.join(imports.select("src", "n"), F.col("file_id") == F.col("src")).groupBy("ball").agg(F.sum("n").alias("n"))
        size = written(more if size is None else size.unionByName(more).groupBy("ball").agg(F.sum("n").alias("n")))
        over = size.filter(F.col("n") > HELD).select("ball")
        depth += 1
        if max_depth is not None and depth >= max_depth:
            return known, over
        step = _pairs_of(frontier.join(over, "ball", "left_anti").join(imports, F.col("file_id") == F.col("src")), "ball").distinct()
        frontier = written(step.join(known, ["ball", "file_id"], "left_anti").withColumn("start", F.lit(False)))
        if frontier.isEmpty():
            return known, over
        known = known.unionByName(frontier)
        if depth % MERGED == 0:
            known = written(known)


def _follow(batches: Iterator[pa.RecordBatch], max_depth: int | None, by_depth: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """WORD starts, all files, depth and a word for each file: the starts that first reach it at that depth, or at any (once, depth 0). batches: PACKED and start of one ball."""
    starts, src, dst = [], [], []
    for batch in batches:
        own, (row, files) = batch["src"].to_numpy(), _unpacked(batch)
        starts.append(own[batch["start"].to_numpy(zero_copy_only=False)])
        src.append(own[row])
        dst.append(files)
    if not starts:
        return
    starts, src, dst = np.unique(np.concatenate(starts)), np.concatenate(src), np.concatenate(dst)
    order = np.argsort(dst, kind="stable")
    ids, at = np.unique(np.concatenate((src[order], dst[order])), return_inverse=True)
    at = at.astype(np.int32)
    a, b = at[: len(src)], at[len(src) :]
    heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for k in range(0, len(starts), WORD):
        lanes = starts[k : k + WORD]
        seen = np.zeros(len(ids), np.uint64)
        seen[np.searchsorted(ids, lanes)] = np.uint64(1) << np.arange(len(lanes), dtype=np.uint64)
        last, own, depth = seen.copy(), seen.copy(), 0
        while max_depth is None or depth < max_depth:
            depth += 1
            live = last != 0
            x, y, first = a, b, heads
            if 2 * np.count_nonzero(live) < len(live):
                some = np.flatnonzero(live[a])
                x, y = a[some], b[some]
                first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
            if not len(x):
                break
            step = np.zeros_like(seen)
            step[y[first]] = np.bitwise_or.reduceat(last[x], first)
            step &= ~seen
            if not step.any():
                break
            seen |= step
            if by_depth:
                yield lanes, ids, depth, step
            last = step
        if not by_depth:
            yield lanes, ids, 0, seen & ~own


def _balls(imports: DataFrame, starts: DataFrame, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows ball, src, dst, start of the balls that a task can hold, dealt by ball; starts (file_id) of the others. starts: file_id."""
    ids = number(starts.select(F.col("file_id").cast("long").alias("file_id")).filter("file_id is not null").distinct(), "no", F.col("file_id"))
    n, files = ids.count(), imports.select("src").distinct().count()
    width = max(1, BALL * n // max(files, 1))
    starts = written(ids.select("file_id", F.expr(f"no div {width}").alias("ball")))
    known, over = _members(imports, starts, max_depth)
    held = known.join(over, "ball", "left_anti").join(imports, F.col("file_id") == F.col("src")).select("ball", "src", "n", "first", "rest", "start")
    parts = max(int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n // width), 10_000))
    return held.repartition(parts, "ball"), starts.join(over, "ball", "left_semi").select("file_id")


def _reached(edges: DataFrame | list[DataFrame], starts: DataFrame, max_depth: int | None, by_depth: bool) -> DataFrame:
    imports = packed_imports(edges)
    held, rest = _balls(imports, starts, max_depth)
    kinds = pa.schema([("file_id", pa.int64()), ("depth", pa.int32()), ("starts", pa.list_(pa.int64()))])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lanes, ids, depth, step in _follow(batches, max_depth, by_depth):
            reached = np.flatnonzero(step)
            for k in range(0, len(reached), SENT):
                some = reached[k : k + SENT]
                words = step[some]
                lane = np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little").view(bool)) % WORD
                ends = np.cumsum(np.r_[0, np.bitwise_count(words)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(lanes[lane]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(len(some), depth, np.int32)), lists], schema=kinds)

    found = held.groupBy("ball").applyInArrow(listed, "file_id long, depth int, starts array<long>").select(F.explode("starts").alias("start"), "file_id", "depth")
    if rest.isEmpty():
        return found
    lanes = start_blocks(rest)
    bits = levels(_pairs_of(imports, "src").withColumnRenamed("file_id", "dst"), lanes, max_depth)
    return found.unionByName(pairs([bits[0].limit(0), *bits[1:]], lanes))


def transitive_imports(edges: DataFrame | list[DataFrame], starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(start, file_id, depth) of all files reached from each start in at most max_depth steps (None: any), the start left out."""
    return _reached(edges, starts, max_depth, True)


def import_reach(edges: DataFrame | list[DataFrame], starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, file_id), as transitive_imports. Rows come file by file, with its starts of a task: tables of them are small where starts reach alike."""
    return _reached(edges, starts, max_depth, False).select("start", "file_id")


def reach_counts(edges: DataFrame | list[DataFrame], starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """file_id, dependents: how many starts reach each file, itself left out; counted on the bits, no pair is made."""
    imports = packed_imports(edges)
    held, rest = _balls(imports, starts, max_depth)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, files, _, step in _follow(batches, max_depth, False):
            n = (n if len(n) else np.zeros(len(files), np.int64)) + np.bitwise_count(step)
        yield pa.RecordBatch.from_arrays([pa.array(files[n > 0]), pa.array(n[n > 0])], names=["file_id", "n"])

    found = held.groupBy("ball").applyInArrow(counted, "file_id long, n long")
    if not rest.isEmpty():
        bits = levels(_pairs_of(imports, "src").withColumnRenamed("file_id", "dst"), start_blocks(rest), max_depth)
        bits = functools.reduce(DataFrame.unionByName, bits[1:], bits[0].limit(0))
        found = found.unionByName(bits.select("file_id", functools.reduce(lambda a, b: a + b, [F.bit_count(c) for c in _W]).cast("long").alias("n")))
    return found.groupBy("file_id").agg(F.sum("n").alias("dependents"))
