"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group. Groups go, largest first, to the shard where the dot product of the group's
shares of bytes, tokens and rows with the shard's residual capacity is highest. A group that would fill more than
half a shard in any of the three is cut into pieces of about 1/PIECES of a shard, else no near equal sizes exist.
Pieces above 1/256 of a shard (at most 3 * 256 * shards of them) are placed on the driver; the others are dealt by
hash over packers that each fill their share of the residual capacities, side by side. The law is `bytes`.

Defined results: a null text counts as empty (0 bytes plus ROW_BYTES, crc32 0) and is in the group of empty texts;
repeated rows are rows of their own, and rows of a hot group spread also if they share a doc_id or have none; an empty
table gives an empty result; other columns are ignored.
Texts never leave the first scan: only their sizes and digests are shuffled. Slots are counted in chunks of a shard,
so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, checkpointed, table

SHARDS = 24
ROW_BYTES = 8
DIMS = ("bytes", "tokens", "rows")
#: Weights in the dot product: the law is about bytes, so they lead.
WEIGHTS = np.array([16.0, 1.0, 1.0])
FINE = 256
PACKER_ROWS = 200_000
CHUNK_ROWS = 50_000
REPEATED = 100_000
PIECES = 8


def place(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), largest first; capacity is (shards, 3) and shrinks in place."""
    scale = np.maximum(capacity.sum(axis=0), 1e-12)
    share, left = items / scale, capacity / scale
    out = np.empty(len(items), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        s = int(np.argmax(left @ (WEIGHTS * share[i])))
        out[i] = s
        left[s] -= share[i]
    capacity[:] = left * scale
    return out


def _packer(left: np.ndarray):
    part = left / np.maximum(left.sum(axis=0), 1e-12)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        items = pdf[list(DIMS)].to_numpy(np.float64)
        pdf["shard"] = place(items, part * items.sum(axis=0))
        return pdf[["g", "piece", "shard"]]

    return step


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sums = [F.sum(c).alias(c) for c in DIMS]
    d = checkpointed(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("g"), F.crc32(text).alias("text_crc32"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("bytes"), F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("tokens"), F.lit(1).cast("long").alias("rows"))
    )
    total = d.agg(*sums).first()
    if not total["rows"]:
        return d.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    cap = {c: max(total[c], 1) / shards for c in DIMS}
    groups = d.groupBy("g").agg(*sums)
    # groups above half a shard in one of three sums: 6 * shards of them at most
    share = F.greatest(*[F.col(c) / cap[c] for c in DIMS])
    big = groups.filter(share > 0.5).select("g", F.ceil(PIECES * share).alias("pieces")).collect()
    if big:
        names = F.broadcast(spark.createDataFrame([(r.g, r.pieces) for r in big], "g binary, pieces long"))
        # doc_ids with many rows in such groups, REPEATED of them at most: their rows are told apart by number, as are those without doc_id
        most = max(64, total["rows"] // REPEATED)
        ids = F.broadcast(d.join(names, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("many")).filter(F.col("many") > most))
        d = d.join(names, "g", "left").join(ids, "doc_id", "left")
        d = d.withColumn("again", F.when(F.col("pieces").isNotNull() & (F.col("doc_id").isNull() | F.col("many").isNotNull()), F.col("row")))
        d = d.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "again"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces", "many")
    else:
        d = d.withColumn("piece", F.lit(0)).withColumn("again", F.lit(None).cast("long"))
    atoms = d.groupBy("g", "piece").agg(*sums)
    coarse = F.greatest(*[F.col(c) / cap[c] for c in DIMS]) * FINE >= 1
    # above 1/FINE of a shard in one of three sums: 3 * FINE * shards rows at most
    large = sorted(atoms.filter(coarse).collect(), key=lambda r: (-r["bytes"], bytes(r.g), r.piece))
    left = np.tile([cap[c] for c in DIMS], (shards, 1))
    placed = place(np.array([[r[c] for c in DIMS] for r in large], np.float64).reshape(-1, 3), left)
    left = np.maximum(left, 0)
    small = atoms.filter(~coarse)
    packers = max(1, -(-total["rows"] // PACKER_ROWS))
    where = small.withColumn("packer", F.pmod(F.xxhash64("g", "piece"), F.lit(packers))).groupBy("packer").applyInPandas(_packer(left), "g binary, piece int, shard int")
    if large:
        rows = [(r.g, r.piece, int(s)) for r, s in zip(large, placed, strict=True)]
        where = where.unionByName(spark.createDataFrame(rows, "g binary, piece int, shard int"))
    chunks = max(1, -(-total["rows"] // (CHUNK_ROWS * shards)))
    out = checkpointed(
        d.join(where, ["g", "piece"]).select("doc_id", "bytes", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "g", "again"), F.lit(chunks)).alias("chunk"))
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "bytes")
    return (
        out.withColumn("rank", F.row_number().over(within))
        .join(starts, ["shard", "chunk"])
        .select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"))
