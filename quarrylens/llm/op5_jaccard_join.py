"""N-gram Jaccard join by MinHash banding.

A document is the set of its 5-word shingles. Band and row counts are chosen for a target recall at the threshold.
Rows with equal sets collapse to one representative: the row with the least (doc_id, hash of its text). These are
shuffled on their band hashes and verified on full shingle sets: pairs at or above the threshold are links. Groups
that bands connect are verified together if they fit a block (BLOCK_DOCS, BLOCK_SHINGLES), and so are larger ones, cut into blocks,
whose sets are so alike that meeting band by band would compare and send more; in the others the sets
that share a band meet in the group of that band, cut into blocks, and a pair counts in the first band that it shares. Everywhere
a pair is a link if it shares a band and reaches the threshold, so the result does not depend on sizes of groups or blocks. Each
pair of blocks is a task of its own that keeps counts and a spanning forest only: pairs are never written out.
Representatives without a band neighbour never travel.

The result has one row per document: `class_id` (least doc_id of its class: documents connected by links),
`copy_of` (least doc_id with the same shingle set) and `n_links` (documents that it is linked to, copies counted).

Defined results: a text of one to four words is one shingle, the whole; texts without words (null, empty, blank) are
equal sets; a null doc_id gets null class and no links; repeated rows are copies of each other; rows of one doc_id with
different texts are documents of their own (two classes may then have one class_id); other columns are ignored, `keep_one` hands
them on whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, raw, renamed, small_batches, table
from .components import components, spread_join
from .textnp import gram_hashes, inside_texts, join_texts, mix, word_hashes, words

SHINGLE = 5
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
RARE = 24
#: In place of a band: a group verified as a whole, in one block or cut into blocks.
WHOLE, WHOLE_CUT = -1, -2


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose_banding(threshold: float = 0.8, recall: float = 0.9998, far: float = 0.3, most_far: float = 0.02) -> Banding:
    """The fewest hashes that reach `recall` at the threshold and make few candidates of pairs at similarity `far`."""
    best = None
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        b = Banding(bands, rows)
        if b.recall(far) <= most_far and (best is None or bands * rows < best.bands * best.rows):
            best = b
    return best


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in one array, and where each text's begin (one more: the end)."""
    data, starts = join_texts(texts)
    w_start, w_end, first = words(data, starts)
    h = word_hashes(data, w_start, w_end)
    grams = gram_hashes(h, SHINGLE)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    ok = inside_texts(first, SHINGLE)
    g, d = grams[ok], doc[: len(grams)][ok]
    n = np.diff(first)
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):  # one shingle: the whole text
        g = np.append(g, gram_hashes(h[first[i] : first[i + 1]], int(n[i])))
        d = np.append(d, i)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(len(texts) + 1))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(g: np.ndarray, starts: np.ndarray, banding: Banding) -> np.ndarray:
    """(texts, bands) hashes; a text without shingles has zeros."""
    n, k = len(starts) - 1, banding.bands * banding.rows
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((n, banding.bands), np.uint64)
    if not len(full):
        return out
    mul, add = _family(k)
    lo, hi = g.astype(np.uint32), (g >> np.uint64(32)).astype(np.uint32)
    at = starts[:-1][full]
    for band in range(banding.bands):
        key = np.full(len(full), band + 1, np.uint64)
        for i in range(band * banding.rows, (band + 1) * banding.rows):
            v = lo * mul[i]
            v ^= hi + add[i]
            v *= np.uint32(0x85EBCA6B)
            v ^= v >> np.uint32(15)
            v *= mul[i]
            key = mix(key ^ np.minimum.reduceat(v, at).astype(np.uint64))
        out[full, band] = key
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
_LEAST = -(1 << 63)


def _row_key():
    """doc_id and a 128-bit hash of the text as 24 bytes that sort like doc_id."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(_LEAST))), 16, "0")), F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _doc_of(key: str):
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_LEAST))


def sketches(docs: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, the row's key, a 128-bit print of the shingle set (f1, f2), its size n, and the band hashes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            g, starts = shingle_sets(raw(b.column("text")))
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g + np.uint64(1)))])
            again = np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(0x5555555555555555)))])
            n = np.diff(starts)
            keys = band_hashes(g, starts, banding)
            f = [(t[starts[1:]] - t[starts[:-1]]).view(np.int64) for t in (total, again)]
            offsets = np.arange(len(n) + 1, dtype=np.int32) * banding.bands
            lists = pa.ListArray.from_arrays(offsets, keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *map(pa.array, f), pa.array(n), lists], schema=_SKETCH)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", _row_key().alias("key"), "text").mapInArrow(step, "doc_id long, key binary, f1 long, f2 long, n long, keys array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets share: rare shingles pair by pair, frequent ones by matrix products."""
    d = len(sets)
    if d == 2:
        c = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]])
    g = np.concatenate(sets)
    doc = np.repeat(np.arange(d), list(map(len, sets)))
    order = np.argsort(g, kind="stable")
    g, doc = g[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    df = np.diff(np.append(edge, len(g)))
    out = np.zeros(d * d, np.int64)
    for k in range(2, RARE + 1):
        at = edge[df == k]
        if len(at):
            members = doc[at[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    out += np.bincount(members[:, i] * d + members[:, j], minlength=d * d) if len(at) * 8 > d * d else 0
            if len(at) * 8 <= d * d:
                i, j = np.triu_indices(k, 1)
                np.add.at(out, (members[:, i] * d + members[:, j]).ravel(), 1)
    out = out.reshape(d, d)
    out = out + out.T
    often = np.flatnonzero(df > RARE)
    for a in range(0, len(often), 2048):
        part = often[a : a + 2048]
        m = np.zeros((d, len(part)), np.float32)
        for col, k in enumerate(part):
            m[doc[edge[k] : edge[k] + df[k]], col] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    out[np.diag_indices(d)] = list(map(len, sets))
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets have a Jaccard similarity of at least the threshold; none is linked to itself."""
    both = common_counts(sets)
    n = np.array(list(map(len, sets)))
    yes = both + 1e-9 >= threshold * (n[:, None] + n[None] - both)
    np.fill_diagonal(yes, False)
    return yes


def _verify(threshold: float):
    """Rows sorted by (grp, i, j) into links and roots of each of these pairs of blocks."""

    def group(key: tuple, weights: np.ndarray, blocks: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, band = key
        yes = linked(sets, threshold)
        if band < 0:  # all sets of a group, not those of one band: as everywhere, only sets that share a band are candidates
            a, b = np.nonzero(yes)
            yes[a, b] = (bands[a] == bands[b]).any(axis=1)
        if i != j:  # inside a block, the pair (i, i) decides
            yes &= blocks[:, None] != blocks[None]
        for earlier in range(band):  # counted there
            yes &= bands[:, earlier, None] != bands[None, :, earlier]
        root = np.arange(len(sets))
        for a in range(len(sets)):  # labels sink to the least representative: they are in order
            roots = {_find(root, x) for x in (a, *np.flatnonzero(yes[a]))}
            least = min(roots)
            for r in roots:
                root[r] = least
        return yes @ weights, np.array([_find(root, x) for x in range(len(sets))])

    def emit(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        reps = [r[0] for r in held]
        weights, blocks = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
        links, roots = group(key, weights, blocks, np.array([r[3] for r in held], np.int64), [np.frombuffer(r[4], np.uint64) for r in held])
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array([reps[k] for k in roots]), pa.array(links), pa.array([key[3] != WHOLE] * len(reps))], schema=_LINKS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            k = zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "band")), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in ("rep", "weight", "block", "keys", "grams")), strict=True)
            for key, row in zip(k, rows, strict=True):
                if key != last and held:
                    yield emit(last, held)
                    held = []
                last = key
                held.append(row)
        if held:
            yield emit(last, held)

    return step


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return int(x)


_LINKS = pa.schema([("rep", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("cut", pa.bool_())])
_DEST = "array<struct<grp: binary, band: int, blocks: int>>"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text", 1 << 20):
        g, starts = shingle_sets(raw(b.column("text")))
        blobs = [g[a:z].tobytes() for a, z in zip(starts, starts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "weight", "keys", "dest")), pa.array(blobs, pa.binary())], ["rep", "weight", "keys", "dest", "grams"])


def _members(reps: DataFrame, block_docs: int, block_shingles: int) -> DataFrame | None:
    """rep, weight, band keys and the groups to be verified in of every representative that a band connects to another; None without any."""
    keyed = reps.filter("n > 0").select("rep", "n", F.posexplode("keys").alias("band", "key"))
    per_key = keyed.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1")
    shared = checkpointed(spread_join(keyed, per_key, "key", "c", keyed.count()))
    total = shared.count()
    if not total:
        return None
    heads = shared.groupBy("key").agg(F.min("rep").alias("head"), F.first("c").alias("c"))
    meets = spread_join(shared.select("key", "rep"), heads, "key", "c", total).filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    groups = components(meets.distinct())
    own = checkpointed(groups.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(reps.select("rep", F.col("copies").alias("weight"), "n", "keys"), "rep"))
    blocks = F.greatest(F.ceil(F.col("c") / block_docs), F.ceil(F.col("s") / block_shingles))
    by_bands = shared.join(own.select("rep", "comp"), "rep").groupBy("comp").agg(F.sum("c").alias("meet"), F.sum(blocks).alias("sent"))
    size = own.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).join(by_bands, "comp")
    whole = F.greatest(F.ceil(F.col("m") / block_docs), F.ceil(F.col("s") / block_shingles))
    cut = (whole > 1) & ((F.col("m") * F.col("m") > 2 * F.col("meet")) | (F.col("m") * whole > F.col("sent")))
    size = checkpointed(size.select("comp", "m", whole.alias("whole"), cut.alias("cut")))
    own = spread_join(own.drop("n"), size, "comp", "m", total)
    dest = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("grp", "band", "blocks"), strict=True)])
    few = own.filter("not cut").select("rep", "weight", "keys", F.array(dest(F.col("comp"), F.when(F.col("whole") > 1, WHOLE_CUT).otherwise(WHOLE), F.col("whole"))).cast(_DEST).alias("dest"))
    if size.filter("cut").isEmpty():
        return few
    many = own.filter("cut").select("rep", "weight", "keys")
    to = shared.join(many.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_list(dest(F.unhex(F.hex("key")), F.col("band"), blocks)).alias("dest"))  # one for each band at most
    return few.unionByName(many.join(to.select("rep", F.col("dest").cast(_DEST).alias("dest")), "rep"))


def _classes(docs: DataFrame, threshold: float, recall: float, block_docs: int, block_shingles: int) -> tuple[DataFrame, DataFrame, int]:
    """Sketches of all rows; f1, f2, rep, root, copies, n_links of each distinct set; and the number of rows."""
    banding = choose_banding(threshold, recall)
    docs = small_batches(docs)
    sk = checkpointed(sketches(docs, banding))
    sets = sk.filter("doc_id is not null").groupBy("f1", "f2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = checkpointed(sets)
    rows = sk.count()
    own = lambda links, root: reps.select("f1", "f2", "rep", root, "copies", (links + F.col("copies") - 1).alias("n_links"))
    members = _members(reps, block_docs, block_shingles)
    if members is None:
        return sk, own(F.lit(0).cast("long"), F.col("rep").alias("root")), rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").select(_row_key().alias("rep"), "text")
    texts = texts.dropDuplicates(["rep"]).join(members, "rep")  # rows with one key have one text: copies go before the shuffle
    grams = texts.select("rep", "weight", "keys", "dest", "text").mapInArrow(_grams, f"rep binary, weight long, keys array<long>, dest {_DEST}, grams binary")
    grams = grams.select("rep", "weight", "keys", "grams", F.explode("dest").alias("d")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("d.blocks")).cast("int"))
    pairs = grams.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("d.blocks") - 1))).select(
        F.col("d.grp").alias("grp"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.col("d.band").alias("band"), "block", "rep", "weight", "keys", "grams")
    pairs = pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = checkpointed(pairs.mapInArrow(_verify(threshold), "rep binary, root binary, links long, cut boolean"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    over = found.filter("cut").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if not over.isEmpty():  # classes that reach over bands and blocks
        top = components(over).select(F.col("node").alias("rep"), F.col("root").alias("top"))
        links = links.join(top, "rep", "left").select("rep", "links", F.coalesce("top", "root").alias("root"))
    reps = reps.join(links, "rep", "left")
    return sk, own(F.coalesce("links", F.lit(0)), F.coalesce("root", "rep").alias("root")), rows


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9998, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, copy_of, class_id, n_links of every row."""
    sk, sets, rows = _classes(docs, threshold, recall, block_docs, block_shingles)
    classes = sets.select(F.struct("f1", "f2").alias("f"), _doc_of("rep").alias("copy_of"), _doc_of("root").alias("class_id"), "n_links", "copies")
    known = spread_join(sk.filter("doc_id is not null").select(F.struct("f1", "f2").alias("f"), "doc_id", "key"), classes, "f", "copies", rows).select("doc_id", "copy_of", "class_id", "n_links")
    none = sk.filter("doc_id is null").select("doc_id", *[F.lit(None if c != "n_links" else 0).cast("long").alias(c) for c in ("copy_of", "class_id", "n_links")])
    return known.unionByName(none)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, the one with the least (doc_id, hash of the text); same columns. Rows without doc_id stay.

    Of rows with one doc_id and text the one whose other columns have the least hash stays, however the rows are partitioned.
    """
    names, docs = docs.columns, renamed(docs, "doc_id", "text")
    _, sets, _ = _classes(docs.select("doc_id", "text"), threshold, 0.9998, BLOCK_DOCS, BLOCK_SHINGLES)
    heads = sets.filter("rep = root").select(F.col("rep").alias("key"))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.md5(F.to_json(F.struct(*others))).alias("other"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.filter("doc_id is not null").select("whole", "other", _row_key().alias("key"))
    one = keyed.join(heads, "key", "left_semi").groupBy("key").agg(F.min_by("whole", "other").alias("whole")).select("whole")
    return one.unionByName(rows.filter("doc_id is null").select("whole")).select("whole.*").toDF(*names)


def oracle(threshold_tenths: int = 8) -> str:
    """The same in SQL, all pairs of sets that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(generate_series(1, len(ws) - {SHINGLE - 1}), lambda i: array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ')))) END AS g FROM d),
sets AS (SELECT g, min(doc_id) AS rep, count(*) AS copies, row_number() OVER (ORDER BY min(doc_id), g) AS k FROM s WHERE doc_id IS NOT NULL GROUP BY g),
grams AS (SELECT k, len(g) AS n, unnest(g) AS gram FROM sets),
meets AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT a, b FROM meets WHERE 10 * c >= {threshold_tenths} * (na + nb - c)),
reach(a, b) AS (SELECT k, k FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS k, (SELECT rep FROM sets WHERE sets.k = min(reach.b)) AS class_id FROM reach GROUP BY a),
n AS (SELECT l.a AS k, sum(x.copies) AS n FROM links l JOIN sets x ON x.k = l.b GROUP BY l.a)
SELECT s.doc_id, rep AS copy_of, class_id, CASE WHEN s.doc_id IS NULL THEN 0 ELSE (coalesce(n.n, 0) + copies - 1)::BIGINT END AS n_links
FROM s LEFT JOIN sets ON sets.g = s.g AND s.doc_id IS NOT NULL LEFT JOIN class ON class.k = sets.k LEFT JOIN n ON n.k = sets.k"""
