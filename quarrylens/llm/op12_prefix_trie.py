"""Trie of conversation prefixes: global sort, adjacent common prefixes, a stack sweep, stitched partitions.

A turn becomes TURN bytes: 16 of a digest of role and text, and the text's length in code points. A conversation is
the bytes of its turns one after the other; sorted bytewise over range partitions, conversations that share a prefix are
neighbours. Each task sweeps its range once: the common prefix with the row before says which nodes of the open path
end there. Nodes that touch neither end of the range are whole. The open ones, the paths of a range's first and last
row, go as one row for each range to one task, which sweeps over ranges as the tasks do over rows; so that row count is
the number of partitions. Children of open nodes learn their parent's name by a join on (range, side, depth).

Conversations that end in a node are hashed in the order of conv_id while they stream by. Equal conversations that fill a
range's end, or several ranges, leave their ids as pieces of CHUNK bytes; the pieces of a node are then read in order.

Defined results: rows without conv_id belong to no conversation and take no part; turns come by turn, null first, equal
ones by the digest of role and text; a null role or text is empty; repeated rows are turns of their own; other columns
are ignored; an empty table gives no rows. A conversation is one value of TURN bytes a turn, however long its texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts_of, table

TURN = 20
CHUNK = 1 << 18
SHARED, MOST = 100, 6
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
FOUND = f"kind string, {NODE}, part int, side int, run long, seq long, body string"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns (hex, 2 * TURN characters a turn) of each conversation. turns: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    token = F.concat(F.upper(digest), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), token.alias("token")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", F.array_join(F.transform("ts", lambda t: t["token"]), "").alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation c - c % 100; h = crc32(c) % 6."""
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST * 2 * TURN).cast("int")
    base = convs.filter(f"conv_id % {SHARED} = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, (MOST - 1) * 2 * TURN).alias("first"))
    both = convs.withColumn("base", F.expr(f"conv_id - conv_id % {SHARED}")).join(base, "base", "left").withColumn("h", h)
    turns = F.concat(F.substring(F.coalesce("first", F.lit("")), F.lit(1), F.col("h")), F.substring("turns", F.col("h") + 1, F.length("turns")))
    return both.select("conv_id", F.unhex(turns).alias("key"))


def common(a: bytes, b: bytes) -> int:
    """Whole turns that both begin with."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    return next(i for i in range(n) if a[i * TURN : i * TURN + TURN] != b[i * TURN : i * TURN + TURN])


def chars(key: bytes, depth: int) -> int:
    return int.from_bytes(key[depth * TURN - 4 : depth * TURN], "big") if depth else 0


class Entry:
    """A node of the open path: sums over what was seen of it, and its children that wait for its name."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "ends", "left", "wait")

    def __init__(self, left: bool = False):
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends, self.left, self.wait = 0, None, 0, 0, 0, None, left, []

    def seen(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def partial(self) -> list:
        return [self.n, self.conv, self.children, self.leaves, self.saved, self.ends]

    def add(self, partial: list) -> None:
        n, conv, children, leaves, saved, ends = partial
        self.seen(n, conv)
        self.children, self.leaves, self.saved, self.ends = self.children + children, self.leaves + leaves, self.saved + saved, self.ends or ends

    def close(self, depth: int, key: bytes, above: Entry | None) -> tuple:
        """The finished node but for its parent's name; sums go on to the entry above."""
        self.leaves = self.leaves or 1  # a node without children has no leaves below
        self.saved += (self.n - 1) * chars(key, depth)
        if above:
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + self.leaves, above.saved + self.saved
        return (self.conv, depth, None, self.n, self.children, self.leaves, self.saved, self.ends)


class Sweep:
    """One range of sorted (key, conv_id): rows for FOUND, the last one the open paths."""

    def __init__(self, part: int):
        self.part, self.key, self.first, self.path = part, None, None, [Entry(left=True)]
        self.lefts: list[list] = []
        self.run, self.hash, self.text, self.seq = -1, None, [], 0
        self.size, self.out = 0, []

    def piece(self) -> None:
        if self.text:
            self.out.append(("piece", *[None] * 8, self.part, None, self.run, self.seq, ",".join(self.text)))
            self.text, self.size, self.seq = [], 0, self.seq + 1

    def end_run(self) -> None:
        """The rows equal to the key are over: within the range their digest is whole, at its begin only pieces are."""
        if self.run == 0:
            self.piece()
        else:
            self.path[-1].ends = self.hash.hexdigest()

    def pop(self) -> None:
        depth, e = len(self.path) - 1, self.path.pop()
        above = self.path[-1]
        above.seen(e.n, e.conv)
        if e.left:
            self.lefts.append(e.partial())
            return
        node = e.close(depth, self.key, above)
        for child in e.wait:
            self.out.append(("node", *child[:2], e.conv, *child[3:], None, None, None, None, None))
        if above.left:
            self.out.append(("node", *node, self.part, 0, None, None, None))
        else:
            above.wait.append(node)

    def row(self, key: bytes, conv: int) -> None:
        if key != self.key:
            if self.key is not None:
                self.end_run()
                shared = common(self.key, key)
                while len(self.path) - 1 > shared:
                    self.pop()
            begin = self.key is None
            while len(self.path) - 1 < len(key) // TURN:
                self.path.append(Entry(left=begin))
            self.first = key if begin else self.first
            self.key, self.run, self.hash, self.seq, self.text, self.size = key, self.run + 1, hashlib.sha256(), 0, [], 0
            mark = str(conv)
        else:
            mark = "," + str(conv)
        self.path[-1].seen(1, conv)
        self.hash.update(mark.encode())
        self.text.append(str(conv))
        self.size += len(mark)
        if self.size > CHUNK:
            self.piece()

    def close(self) -> None:
        """The last path stays open; what is left of the last run goes as a piece."""
        if self.key is None:
            return
        self.piece()
        last = []
        while self.path:
            e = self.path.pop()
            if self.path:
                self.path[-1].seen(e.n, e.conv)
            last.append(e.partial())
            for child in e.wait:
                self.out.append(("node", *child, self.part, 1, None, None, None))
        body = json.dumps([self.first.hex(), self.key.hex(), self.run, self.lefts[::-1], last[::-1]])
        self.out.append(("open", *[None] * 8, self.part, None, None, None, body))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Sweep(TaskContext.get().partitionId())
    for b in batches:
        for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            s.row(key, conv)
            if len(s.out) >= 4096:
                yield _batch(s.out)
                s.out = []
    s.close()
    if s.out:
        yield _batch(s.out)


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Open paths of all ranges, in order: their nodes, with the places (range, side) and runs of ids each stands for."""
    path, key, out = [], b"", []

    def pop(key: bytes) -> None:
        depth, (e, places, runs) = len(path) - 1, path.pop()
        node = list(e.close(depth, key, path[-1][0] if path else None))
        for child in e.wait:
            child[0][2] = e.conv
            out.append(child)
        (path[-1][0].wait if path else out).append((node, places, runs))

    for part, body in pdf.sort_values("part")[["part", "body"]].itertuples(index=False):
        first, last, run, lefts, rights = json.loads(body)
        first, last = bytes.fromhex(first), bytes.fromhex(last)
        shared = common(key, first)
        while len(path) - 1 > shared:
            pop(key)
        through = len(first) // TURN - len(lefts)  # the depth down to which one path goes through the whole range
        for depth in range(len(first) // TURN + 1):
            if depth == len(path):
                path.append((Entry(), [], []))
            e, places, runs = path[depth]
            e.add(rights[depth] if depth <= through else lefts[depth - through - 1])
            places.append((part, 0))
            if depth == len(first) // TURN:
                runs.append((part, 0))
        if last != first:
            while len(path) - 1 > through:
                pop(first)
            for depth in range(through + 1, len(last) // TURN + 1):
                e = Entry()
                e.add(rights[depth])
                path.append((e, [(part, 1)], [(part, run)] if depth == len(last) // TURN else []))
        key = last
    while path:
        pop(key)
    rows = [(*node, [p for p, _ in places], [s for _, s in places], [p for p, _ in runs], [r for _, r in runs]) for node, places, runs in out]
    names = [c.split()[0] for c in NODE.split(", ")] + ["parts", "sides", "run_parts", "runs"]
    out = pd.DataFrame(rows, columns=names)
    return out.assign(**{c: out[c].astype("Int64") for c in names[:7]})


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids that come in pieces, in order by node."""
    node, digest = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("pieces", pa.string())])

    def out():
        return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "pieces": [digest.hexdigest()]}, schema)

    for b in batches:
        for conv, depth, body in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "body")), strict=True):
            if (conv, depth) != node:
                if node:
                    yield out()
                node, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(body.encode())
    if node:
        yield out()


def trie(convs: DataFrame) -> DataFrame:
    """The nodes over conversations (conv_id, key); a node is known by its smallest member and its depth."""
    parts = parts_of(convs)
    ranged = convs.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = checkpointed(ranged.mapInArrow(_sweep, FOUND))
    names = [c.split()[0] for c in NODE.split(", ")]
    paths = found.filter("kind = 'open'").select(F.lit(0).alias("all"), "part", "body")  # a row for each range
    stitched = checkpointed(paths.groupBy("all").applyInPandas(lambda pdf: _stitch(pdf), f"{NODE}, parts array<int>, sides array<int>, run_parts array<int>, runs array<long>"))
    each = lambda a, b, **names: stitched.select("conv_id", "depth", F.explode(F.arrays_zip(a, b)).alias("x")).select("conv_id", "depth", *[F.col(f"x.{v}").alias(k) for k, v in names.items()])
    places = each("parts", "sides", part="parts", side="sides").withColumnRenamed("conv_id", "parent")
    nodes = found.filter("kind = 'node'")
    inner = nodes.filter("part is null").select(*names)
    outer = nodes.filter("part is not null").withColumn("above", F.col("depth") - 1)
    outer = outer.join(places.withColumnRenamed("depth", "above"), ["part", "side", "above"]).withColumn("parent_conv_id", F.col("parent")).select(*names)
    pieces = found.filter("kind = 'piece'").select("part", "run", "seq", "body").join(each("run_parts", "runs", part="run_parts", run="runs"), ["part", "run"])
    digests = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "run", "seq").select("conv_id", "depth", "body").mapInArrow(_join_pieces, "conv_id long, depth long, pieces string")
    open_ = stitched.select(*names).join(digests, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("pieces", "ends")).select(*names)
    none = hashlib.sha256().hexdigest()
    return inner.unionByName(outer).unionByName(open_).withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).drop("ends")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))))


def oracle() -> str:
    from .op11_merkle_manifest import CRC_SQL

    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS u, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC_SQL.format("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, k, u, chars FROM c JOIN t ON t.conv_id = base AND k <= h UNION ALL SELECT c.conv_id, 1, k, u, chars FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(u, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, CASE WHEN depth > 0 THEN substr(path, 1, 64 * (depth::INT - 1)) END AS up FROM p GROUP BY path, depth),
k AS (SELECT up, count(*) AS children FROM n GROUP BY up),
a AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.up = path),
s AS (SELECT path, sum(children = 0) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT substr(path, 1, 64 * i::INT) AS path, children, n, chars FROM (SELECT *, unnest(range(depth + 1)) AS i FROM a)) GROUP BY path)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, a.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM a JOIN s ON s.path = a.path LEFT JOIN n b ON b.path = a.up LEFT JOIN e ON e.path = a.path"""
