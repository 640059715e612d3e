"""Merkle manifest of a dataset by superblock reduction, with a proof for every row.

Rows become leaves, numbered within their source in the order of doc_id. A bucket holds the fanout^levels nodes of one
source whose numbers agree after division; one step collapses `levels` levels of each bucket to its root, and the same
step is repeated on bucket roots until each source has one node, its subroot. Subroots, in the order of sources, are
reduced likewise to the root. On the way back every bucket is opened once more: the proof inside it (lower) is put
before the proof of its root (upper). Texts stay in the first scan; a bucket is a bounded group however hot its source is.

A proof is two arrays, `left` and `right`: on each level the digests of the siblings before and after the node, joined.
`fold` computes the root that a leaf and a proof stand for, in Spark's own functions.

Defined results: a null field counts as `-`; rows without a source come first, as a source of their own; rows of one
doc_id, or of none (these come first), follow each other by their leaves; equal rows are leaves of their own; a source
of one row has its leaf as subroot, a dataset of one source its subroot as root (proofs of both may be empty); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, parts_of, table

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**changed: Column) -> Column:
    """The digest of a row's five fields, each by its length and value; `changed` replaces fields."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def fold(digest: Column, left: Column, right: Column) -> Column:
    """The root that the digest of a leaf leads to by a proof."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), digest, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


def tower(nodes: list[str], fanout: int, steps: int) -> list[list[str]]:
    """The digests of each level, the given nodes first."""
    out = [nodes]
    for _ in range(steps):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def height(n: int, fanout: int) -> int:
    """Levels above n nodes until one is left."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """pos (from 0, in the given order) and n (rows) within each key; no task holds a key, only a range of it.

    Rows are written once after range partitioning, so that both readings see the same ranges.
    """
    ranged = checkpointed(rows.repartitionByRange(parts_of(rows), key, *order).withColumn("p", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "p").agg(F.count("*").alias("c"))  # a row for each partition and key in it
    counts = counts.select(key, "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(key, "p").orderBy(*order))
    return ranged.withColumn("i", inside).join(counts, [key, "p"]).withColumn("pos", F.col("start") + F.col("i") - 1).drop("p", "i", "start")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of key, pos, n, digest: the given nodes, then the roots of their buckets, until each key has one node."""
    block = fanout**levels

    def collapse(key, pdf):
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        top = tower(pdf["digest"].tolist(), fanout, min(levels, height(n, fanout)))[-1]
        return pd.DataFrame({"key": [key[0]], "pos": [key[1]], "n": [-(-n // block)], "digest": top})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        buckets = out[-1].select("key", "pos", "n", "digest").groupBy("key", F.expr(f"pos div {block}").alias("bucket"))
        out.append(checkpointed(buckets.applyInPandas(collapse, "key string, pos long, n long, digest string")))
    return out


def _descend(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first of the tables with left and right, the proofs up to the tops (key, pos, left, right and names), and the names of its top."""
    block, upper = fanout**levels, tops
    names = [c for c in tops.columns if c not in ("key", "pos", "left", "right")]

    def opened(columns: list[str]):
        def lower(pdf, above):
            pdf, above = pdf.sort_values("pos"), above.iloc[0]
            steps = min(levels, height(int(pdf["n"].iloc[0]), fanout))
            lefts, rights = [], []
            for nodes in tower(pdf["digest"].tolist(), fanout, steps)[:steps]:
                runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
                lefts.append(["".join(r[:j]) for r in runs for j in range(len(r))])
                rights.append(["".join(r[j + 1 :]) for r in runs for j in range(len(r))])
            path = lambda side, up: [[level[i // fanout**j] for j, level in enumerate(side)] + list(up) for i in range(len(pdf))]
            return pdf[columns].assign(left=path(lefts, above["left"]), right=path(rights, above["right"]), **{c: above[c] for c in names})

        return lower

    for nodes in reversed(tables[:-1]):
        ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema), "left array<string>, right array<string>", *(f"{c} string" for c in names)])
        buckets = nodes.groupBy("key", F.expr(f"pos div {block}").alias("bucket"))
        upper = buckets.cogroup(upper.withColumnRenamed("pos", "bucket").groupBy("key", "bucket")).applyInPandas(opened(nodes.columns), ddl)
    return upper


def manifest(docs: DataFrame, claim: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, position, leaf, claim, left, right, subroot, root of every row.

    claim: a digest to carry along for checking by `fold`, such as the leaf of a later copy; null (also without a
    claim) where it is the leaf.
    """
    digest = leaf()
    claim = F.lit(None).cast("string") if claim is None else F.when(claim != digest, claim)
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # bytewise order, null first
    rows = checkpointed(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), claim.alias("claim"), F.monotonically_increasing_id().alias("row")))
    nodes = numbered(rows, "key", "doc_id", "digest", "row").drop("row")
    # pandas has no nulls among integers: doc_id travels as text
    nodes = checkpointed(nodes.withColumn("doc_id", F.col("doc_id").cast("string")))
    own = _climb(nodes, fanout, levels)
    none = F.array().cast("array<string>")
    sources = numbered(own[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "key", "name")
    over = _climb(checkpointed(sources), fanout, levels)
    tops = over[-1].select("key", "pos", none.alias("left"), none.alias("right"), F.col("digest").alias("root"))
    if len(over) == 1:  # one source
        tops = tops.join(over[0].select("key", "pos", "name", "digest"), ["key", "pos"])
    subroots = _descend(over, tops, fanout, levels).select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("subroot"), "root")
    if len(own) == 1:  # no source has more than one row
        out = nodes.join(subroots.drop("pos"), "key")
    else:
        out = _descend(own, subroots, fanout, levels)
    source = F.when(F.col("key") != "0", F.expr("substring(key, 2)")).alias("source")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), source, F.col("pos").alias("position"), F.col("digest").alias("leaf"), "claim", "left", "right", "subroot", "root")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = leaf(text=F.translate(F.col("text"), "\n", ""))
    m = manifest(docs, F.when(even, tampered))
    proof = F.sha2(F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), ""), 256)
    folded = fold(F.coalesce("claim", "leaf"), F.col("left"), F.col("right"))
    return m.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal number, bit by bit.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"


def oracle() -> str:
    """Level by level over whole sources, with the siblings of every node on its path."""
    field = lambda c, v=None: f"coalesce(strlen({v or c}::VARCHAR)::VARCHAR || ':' || {v or c}::VARCHAR, '-')"
    leaf_sql = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else None) for c in FIELDS) + ")"

    def up(name: str, nodes: str, key: str) -> str:
        """lvl 0 are the nodes; a level exists while a key has several."""
        return f"""{name}(lvl, {key}, pos, n, digest) AS (SELECT 0, {key}, pos, n, digest FROM {nodes}
  UNION ALL SELECT lvl + 1, {key}, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lvl, {key}, pos // 3, (n + 2) // 3)"""

    def paths(name: str, tree: str, nodes: str, key: str) -> str:
        """Siblings of every node, level by level: strings before and after it."""
        return f"""{name} AS (SELECT x.{key}, x.pos, list(coalesce(b, '') ORDER BY lvl) FILTER (lvl IS NOT NULL) AS l, list(coalesce(a, '') ORDER BY lvl) FILTER (lvl IS NOT NULL) AS r
  FROM {nodes} x LEFT JOIN (SELECT x.{key}, x.pos, t.lvl, string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < t.pos) AS b, string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > t.pos) AS a
    FROM {nodes} x JOIN {tree} t ON t.{key} = x.{key} AND t.n > 1 AND t.pos = x.pos // (3 ** t.lvl)::BIGINT JOIN {tree} s ON s.{key} = t.{key} AND s.lvl = t.lvl AND s.pos // 3 = t.pos // 3 GROUP BY ALL) y ON y.{key} = x.{key} AND y.pos = x.pos GROUP BY ALL)"""

    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS k, {leaf_sql("text")} AS digest, {leaf_sql("replace(text, chr(10), '')")} AS cut, {CRC_SQL.format("doc_id")} % 2 = 0 AS even FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
{up("t", "x", "k")}, s AS (SELECT '' AS o, k, digest, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{up("u", "s", "o")}, {paths("px", "t", "x", "k")}, {paths("ps", "u", "s", "o")},
f AS (SELECT x.doc_id, x.digest AS leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, CASE WHEN even THEN cut ELSE x.digest END AS claim,
 list_concat(coalesce(px.l, []), coalesce(ps.l, [])) AS l, list_concat(coalesce(px.r, []), coalesce(ps.r, [])) AS r
 FROM x JOIN s ON s.k = x.k JOIN px ON px.k = x.k AND px.pos = x.pos JOIN ps ON ps.pos = s.pos),
g AS (SELECT *, list_reduce(list_prepend(claim, list_transform(range(len(l)), lambda i: l[i + 1] || '|' || r[i + 1])), lambda a, z: sha256(string_split(z, '|')[1] || a || string_split(z, '|')[2])) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(len(l)), lambda i: l[i + 1] || r[i + 1]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""
