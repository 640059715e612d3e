"""Content-defined anchors of fixed-length windows, and which of them occur more than once in a corpus.

A window of `width` symbols (bytes or words) is represented by the least hashed gram of `gram` symbols inside it, the
leftmost of equals. Equal windows have equal anchors at equal offsets, so it is enough to bring the windows of one
anchor together; an anchor stands for about half of width - gram windows, so this thins the suffixes to be moved.

Grams that a sample of the corpus shows as hot (`profile`) are avoided as anchors wherever a window has another gram;
windows of hot grams only have anchors of their own. So no anchor gathers what its neighbours could carry.

`Corpus` holds the documents shuffled once, into groups of about CHUNK bytes by a hash of doc_id and text, so that rows
that share a doc_id, or have none, spread like all others. Three steps read that one exchange, group by group in chunks
that are cut alike each time: anchors go to buckets by key and the repeated ones are reported back by their number in
the chunk (`repeated`); the text around repeated anchors goes to buckets for comparison; results come back to their
chunks. A key that a chunk holds several times leaves it once, and a task sends a key that it has met before at most
once more (a table of fixed size remembers), so a bucket gets at most two records for each key and task, however hot a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, chunks, parts_of, raw, small_batches, trim
from .textnp import gram_hashes, join_texts, mix, word_hashes, words

NO_ID = -(1 << 63)
CHUNK = 1 << 20
PIECE = 1 << 18
BUCKET_BYTES = 4 << 20
#: Bytes of text in the sample that tells hot grams and splitters; at least one in SAMPLE_RATE documents of a large corpus.
SAMPLE_BYTES, SAMPLE_RATE = 8 << 20, 1000
HOT_SHARE, HOT_MOST, LEADS_MOST = 32, 100_000, 200_000
SEEN_SLOTS = 1 << 18
_T32 = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)
_LOW = np.uint64(0xFFFFFFFF)


def byte_gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of the `gram` (a power of two) bytes from each position on."""
    h, k, p = _T32[data], 1, np.uint32(0x9E3779B1)
    while k < gram:
        h = h[:-k] * p + h[k:] if len(h) > k else h[:0]
        k, p = k * 2, np.uint32(int(p) * int(p) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every `width` successive hashes, the leftmost of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for a in range(0, n, PIECE):
        part = h[a : min(len(h), a + PIECE + width - 1)]
        v = (part.astype(np.uint64) << np.uint64(32)) | np.arange(len(part), dtype=np.uint64)
        k = 1
        while k * 2 <= width:
            v = np.minimum(v[:-k], v[k:])
            k *= 2
        if k < width:
            v = np.minimum(v[: len(part) - width + 1], v[width - k :])
        out[a : a + len(v)] = (v & _LOW).astype(np.int64) + a
    return out


@dataclass
class Symbols:
    """The symbols of a chunk of texts. `starts`: per text its first symbol (one more: the end)."""

    data: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray  # 32-bit hash of the gram from each symbol on
    keys: Callable[[np.ndarray], np.ndarray]  # 64-bit key of the grams at these symbols
    leads: Callable[[np.ndarray], np.ndarray]  # leading bytes of the symbols there, as numbers that sort alike
    again: Callable[[np.ndarray], np.ndarray]  # hash of the bytes of the gram after those
    lo: np.ndarray | None = None  # words: bytes of each
    hi: np.ndarray | None = None
    word_hash: np.ndarray | None = None

    def cut(self, start: int, end: int) -> bytes:
        if self.lo is None:
            return self.data[start:end].tobytes()
        return self.data[self.lo[start] : self.hi[end - 1]].tobytes()


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int
    by_word: bool = False

    def read(self, texts: list[bytes]) -> Symbols:
        data, starts = join_texts(texts)
        if self.by_word:
            lo, hi, first = words(data, starts)
            wh = word_hashes(data, lo, hi)
            g = gram_hashes(wh, self.gram)
            return Symbols(data, first, (g >> np.uint64(32)).astype(np.uint32), lambda p: mix(g[p]), lambda p: mix(g[p]), lambda p: g[p], lo, hi, wh)
        padded = np.concatenate([data, np.zeros(self.gram, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

        def lead(p):
            return np.ascontiguousarray(eight[p]).view(">u8").ravel().astype(np.uint64)

        def key(p):
            return mix(mix(lead(p)) ^ lead(p + 8))

        return Symbols(data, starts, byte_gram_hash(data, self.gram), key, lead, lambda p: mix(lead(p + 8)))

    def ends(self, s: Symbols) -> np.ndarray:
        """Per text the end of its symbols: a text's line end is no symbol of it."""
        return s.starts[1:] - (0 if self.by_word else 1)

    def anchors(self, s: Symbols, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of all windows inside the texts: text, position, first and last window start."""
        h = s.hashes
        if hot is not None and len(hot):
            low = np.flatnonzero(h <= hot[-1])
            h = h.copy()
            h[low[np.isin(h[low], hot)]] = 0xFFFFFFFF
        pos = window_minima(h, self.width - self.gram + 1)
        at = np.arange(len(pos))
        text = np.searchsorted(s.starts, at, "right") - 1
        at = at[at + self.width <= self.ends(s)[text]] if len(pos) else at
        if not len(at):
            return at, at, at, at
        p = pos[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return text[at[first]], p[first], at[first], at[last]


def by_bucket(step: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Turn rows sorted by `bucket` into one call for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            col = b.column("bucket").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(col)) + 1).tolist(), len(col)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                if last is not None and col[a] != last:
                    yield from step(last, held)
                    held = []
                    trim()
                last = int(col[a])
                held.append(b.slice(a, z - a))
        if last is not None:
            yield from step(last, held)
        held.clear()
        trim()

    return run


def column(held: list[pa.RecordBatch], name: str, dtype) -> np.ndarray:
    parts = [x for b in held for x in b.column(name).to_pylist()]
    return np.frombuffer(b"".join(parts), dtype)


def per_text(doc: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Groups of rows with one doc, as slices of arrays that are sorted by doc."""
    if not len(doc):
        return
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for a, z in zip(edges, [*edges[1:], len(doc)], strict=True):
        yield int(doc[a]), *(x[a:z] for x in arrays)


@dataclass
class Chunk:
    """Rows of one group, in the order of (doc_id, hash of the text): `batch` has all columns, `lists` what was joined to the group."""

    gid: int
    sub: int
    batch: pa.RecordBatch
    lists: list[bytes] | None

    def texts(self) -> list[bytes]:
        return raw(self.batch.column("text"))

    def numbers(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)


def chunks_of(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[Chunk]:
    """The groups in chunks of at most `most` bytes of text, a longer text alone. Cuts depend on the rows of the group only."""
    held, size, last, sub, lists = [], 0, None, 0, None

    def emit() -> Chunk:
        whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Chunk(last, sub, whole, lists)

    for b in batches:
        gid = b.column("gid").to_numpy()
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.append(np.flatnonzero(gid[1:] != gid[:-1]) + 1, len(gid)).tolist() if len(gid) else []
        i = 0
        for end in ends:
            if gid[i] != last:
                if held:
                    yield emit()
                held, size, last, sub = [], 0, int(gid[i]), 0
                lists = b.column("lists")[i].as_py() if "lists" in b.schema.names else None
            while i < end:
                k = min(end, int(np.searchsorted(total, total[i] + most - size, "right")) - 1)
                if k > i or not held:
                    k = max(k, i + 1)
                    held.append(b.slice(i, k - i))
                    size += int(total[k] - total[i])
                    i = k
                if i < end:  # the next text does not fit
                    yield emit()
                    held, size, sub = [], 0, sub + 1
        trim()
    if held:
        yield emit()
    trim()


class Seen:
    """Keys that a task has sent: how often, in a table of fixed size. A forgotten key is only sent again."""

    def __init__(self, slots: int = SEEN_SLOTS):
        self.key, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def often(self, keys: np.ndarray) -> np.ndarray:
        """Whether these distinct keys were sent twice already; those that weren't count as sent now."""
        at = (mix(keys) % np.uint64(len(self.key))).astype(np.int64)
        same = self.key[at] == keys
        known = same & (self.count[at] >= 2)
        self.count[at[same]] += 1
        other = at[~same]
        self.count[other] -= 1
        free = ~same & (self.count[at] <= 0)
        self.key[at[free]], self.count[at[free]] = keys[free], 1
        return known


def profile(docs: DataFrame, shape: Shape, buckets: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of hot grams, and sorted leads of other anchors (LEADS_MOST at most), from a sample of documents.

    The sample grows with the corpus and is counted by Spark; what comes to the driver is bounded by HOT_MOST and LEADS_MOST.
    """
    rate = int(min(SAMPLE_RATE, max(1, total // SAMPLE_BYTES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = rows.filter(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(rate)) == 0).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK):
            s = shape.read(raw(b.column("text")))
            p = shape.anchors(s)[1]
            both = np.column_stack([s.hashes[p].astype(np.int64), s.leads(p).view(np.int64)])
            both, n = np.unique(both, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n)], ["hash", "lead", "n"])

    anchors = checkpointed(few.mapInArrow(count, "hash long, lead long, n long").groupBy("hash", "lead").agg(F.sum("n").alias("n")))
    whole = anchors.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_SHARE, whole // min(8 * buckets, HOT_MOST))
    hot = anchors.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash").collect()  # HOT_MOST at most
    hot = np.sort(np.array([r.hash for r in hot], np.uint32))
    leads = anchors.orderBy(F.xxhash64("hash", "lead"), "hash", "lead").limit(LEADS_MOST).collect()
    gone = set(hot.tolist())
    x = np.array([r.lead for r in leads for _ in range(min(r.n, HOT_SHARE)) if r.hash not in gone], np.int64)
    return hot, np.sort(x.view(np.uint64))


class Corpus:
    """Documents in groups: d (doc_id, null as NO_ID), h (hash of the text), text, gid, and `rest` with other columns."""

    def __init__(self, docs: DataFrame, shape: Shape, *others: str, bucket_bytes: int = BUCKET_BYTES):
        rest = [F.struct(*[F.col(c) for c in others]).alias("rest")] if others else []
        d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)
        self.shape, self.parts = shape, parts_of(small_batches(docs))
        self.columns = ["gid", "d", "h", "text", *(["rest"] if others else [])]
        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        self.buckets = int(max(8, total // bucket_bytes))  # sized by the texts, so that a bucket fits a task at any scale
        groups = int(max(self.parts, total // CHUNK))
        self.hot, self.leads = profile(docs, shape, self.buckets, total)
        d = d.withColumn("h", F.xxhash64("text")).withColumn("gid", F.pmod(F.xxhash64("d", "h"), F.lit(groups)))
        order = ["gid", "d", "h", "text"]  # a step that doesn't ask for nth has no window, so the order is asked for by itself
        self.rows = d.repartition(self.parts, "gid").sortWithinPartitions(*order).withColumn("nth", F.row_number().over(Window.partitionBy("gid").orderBy("d", "h", "text")))

    def repeated(self) -> DataFrame:
        """gid and lists: the anchors whose gram occurs again, by their numbers in their chunks (see `marked`)."""
        buckets, shape, hot = self.buckets, self.shape, self.hot

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Seen()
            for c in chunks_of(batches):
                s = shape.read(c.texts())
                p = shape.anchors(s, hot)[1]
                if not len(p):
                    continue
                key = s.keys(p)
                order = np.argsort(key, kind="stable")
                k = key[order]
                fresh = np.ones(len(k), bool)
                fresh[1:] = k[1:] != k[:-1]
                alone = fresh.copy()
                alone[:-1] &= fresh[1:]
                head = order[fresh]
                known = seen.often(key[head])
                done = np.ones(len(p), bool)  # reported here: others of the chunk or of the task have the gram
                done[order[alone]] = False
                done[head[known]] = True
                if done.any():
                    yield _record(c.gid % buckets, c, len(p), np.flatnonzero(done), None)
                ask = head[~known]
                to = (key[ask] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                for bucket, i in per_text(to[by], ask[by]):
                    yield _record(bucket, c, len(p), np.where(done[i], ~i, i), key[i])

        def reply(_, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in held:
                own = b.filter(b.column("key").is_null())
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([own.column("gid"), own.column("mark")], ["gid", "marks"])
            asked = [x for b in held if (x := b.filter(b.column("key").is_valid())).num_rows]
            if not asked:
                return
            blobs = [x for b in asked for x in b.column("mark").to_pylist()]
            key = _keys48([x for b in asked for x in b.column("key").to_pylist()])
            counts = np.array([len(x) // 4 - 2 for x in blobs])
            order = np.argsort(key, kind="stable")
            k = key[order]
            same = k[1:] == k[:-1]
            hit = np.zeros(len(k), bool)
            hit[1:] |= same
            hit[:-1] |= same
            found = np.zeros(len(k), bool)
            found[order[hit]] = True
            gids, out, at = [], [], 0
            for g, blob, n in zip((x for b in asked for x in b.column("gid").to_pylist()), blobs, counts.tolist(), strict=True):
                x = np.frombuffer(blob, np.int32)
                mine = x[2:][found[at : at + n]]
                mine = mine[mine >= 0]
                at += n
                if len(mine):
                    gids.append(g)
                    out.append(np.concatenate([x[:2], mine]).tobytes())
            if gids:
                yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(out, pa.binary())], ["gid", "marks"])

        sent = self.rows.select("gid", "d", "h", "text").mapInArrow(send, "bucket int, gid long, mark binary, key binary")
        got = sent.repartition(self.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(reply), "gid long, marks binary")
        return got.groupBy("gid").agg(F.collect_list("marks").alias("lists"))

    def with_lists(self, lists: DataFrame) -> DataFrame:
        """The documents; the first row of each group has the group's lists. The texts stay where they are."""
        right = lists.select(F.col("gid").alias("g"), "lists").hint("shuffle_merge")
        return self.rows.join(right, (F.col("gid") == F.col("g")) & (F.col("nth") == 1), "left").select(*self.columns, "lists")


_ROW = pa.schema([("bucket", pa.int32()), ("gid", pa.int64()), ("mark", pa.binary()), ("key", pa.binary())])


def _record(bucket: int, c: Chunk, anchors: int, marks: np.ndarray, keys: np.ndarray | None) -> pa.RecordBatch:
    """One record of a chunk: its number, its count of anchors and some of their numbers, with 48 bits of their keys."""
    blob = None
    if keys is not None:
        k = keys >> np.uint64(16)
        blob = k.astype(np.uint32).tobytes() + (k >> np.uint64(32)).astype(np.uint16).tobytes()
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "gid": [c.gid], "mark": [np.concatenate([[c.sub, anchors], marks]).astype(np.int32).tobytes()], "key": [blob]}, schema=_ROW)


def _keys48(blobs: list[bytes]) -> np.ndarray:
    out = []
    for b in blobs:
        n = len(b) // 6
        out.append(np.frombuffer(b, np.uint32, n).astype(np.uint64) | (np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)))
    return np.concatenate(out)


def marked(c: Chunk) -> tuple[np.ndarray, int] | None:
    """Numbers of the chunk's anchors that occur again, and the count of its anchors when they were numbered."""
    mine = [x for x in (np.frombuffer(b, np.int32) for b in c.lists or ()) if x[0] == c.sub]
    return (np.unique(np.concatenate([x[2:] for x in mine])), int(mine[0][1])) if mine else None


def around(c: Chunk, shape: Shape, hot: np.ndarray) -> tuple | None:
    """Symbols of a chunk, and text, position, first and last window start of its anchors that occur again."""
    got = marked(c)
    if got is None or not len(got[0]):
        return None
    s = shape.read(c.texts())
    text, p, first, last = shape.anchors(s, hot)
    if len(p) != got[1]:
        raise ValueError("a group of texts was cut otherwise than before")
    i = got[0]
    return s, text[i], p[i], first[i], last[i]


class Contexts:
    """Contexts (bytes, place of the anchor) that a task has met, with the earliest row of each; the rarest are forgotten first."""

    def __init__(self, most: int = 20_000):
        self.most, self.known = most, {}

    def earlier(self, key: tuple, row: tuple) -> tuple | None:
        """The row met before, if it is not later than this one; else this one is kept for the next."""
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.most:
                self.known = {k: [n // 2, r] for k, (n, r) in self.known.items() if n > 1}
                if len(self.known) >= self.most:
                    self.known = {}
            self.known[key] = [1, row]
            return None
        got[0] += 1
        if got[1] <= row:
            return got[1]
        got[1] = row
        return None


def grouped(gid: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Records (a structured array) as one binary for each group."""
    order = np.argsort(gid, kind="stable")
    ids, blobs = [], []
    for g, i in per_text(gid[order], order):
        ids.append(g)
        blobs.append(records[i].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["gid", "found"])
