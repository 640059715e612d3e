"""Removal of repeated 100-byte strings by a sparse, range-partitioned suffix array.

Windows of 100 bytes are represented by content-defined anchors (see `repeats`). The suffixes that start at repeated
anchors, with the text before them, are range-partitioned by their leading bytes at splitters taken from a sample that
grows with the corpus; where the splitters are fewer than the buckets, a range is dealt on by the bytes that follow.
Each bucket sorts its suffixes, and the reversed texts before them, by multikey quicksort over 8-byte tokens; longest
common prefixes of neighbours in the two orders tell which windows are equal, byte for byte, and the earliest of them
stays. Equal windows have equal leading bytes, so none is cut off from its like by a boundary between buckets.

The operator returns removed byte spans; `clean` applies them. Defined results: a null text counts as empty; texts
shorter than 100 bytes lose nothing; rows with one doc_id are ordered by a 64-bit hash of their texts (xxHash, seed 42),
and equal rows count as successive documents; a null doc_id comes first; other columns are ignored (`clean` hands them
on, whatever their names); an empty table gives an empty result. Equal contexts leave a task once, but for earlier ones
met later, so copies do not pile up anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, table
from .repeats import CHUNK, NO_ID, Chunk, Contexts, Corpus, Shape, around, by_bucket, chunks_of, column, grouped, per_text

WIDTH, GRAM = 100, 16
SHAPE = Shape(WIDTH, GRAM)
_HEAD = pa.schema([("bucket", pa.int64()), ("gid", pa.int64()), ("sub", pa.int32()), *[(c, pa.binary()) for c in ("items", "data")]])
_DDL = "bucket long, gid long, sub int, items binary, data binary"
#: An item: a row of its chunk and `size` bytes of its text from `at` on, with the anchor `left` bytes in.
ITEM = np.dtype([("d", "<i8"), ("h", "<i8"), ("row", "<i4"), ("at", "<i4"), ("left", "<i2"), ("size", "<i2")])
SPAN = np.dtype([("sub", "<i4"), ("row", "<i4"), ("start", "<i4"), ("end", "<i4")])


def multikey_sort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a token matrix, and the tokens that each row shares with the one before.

    Multikey quicksort, all groups of a depth at once: rows that agree so far are sorted by their next token, and only
    those that still agree go one token deeper.
    """
    n, depth = tokens.shape
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order whose group has more than one row
    group = np.zeros(n, np.int64)
    for d in range(depth):
        rows = order[open_]
        t = tokens[rows, d]
        sub = np.lexsort((t, group))
        order[open_] = rows[sub]
        t, group = t[sub], group[sub]
        same_group = np.zeros(len(open_), bool)
        same_group[1:] = group[1:] == group[:-1]
        same = same_group.copy()
        same[1:] &= t[1:] == t[:-1]
        shared[open_[same]] = d + 1
        start = ~same
        alone = start.copy()
        alone[:-1] &= start[1:]
        group = np.cumsum(start)
        open_, group = open_[~alone], group[~alone]
        if not len(open_):
            break
    return order, shared


def _tokens(matrix: np.ndarray) -> np.ndarray:
    pad = -matrix.shape[1] % 8
    if pad:
        matrix = np.concatenate([matrix, np.zeros((len(matrix), pad), np.uint8)], axis=1)
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def suffix_order(matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (rows, zero-padded) and the bytes that each shares with the one before."""
    order, shared = multikey_sort(_tokens(matrix))
    lcp = np.zeros(len(order), np.int64)
    at = 8 * shared[1:]
    width = matrix.shape[1]
    lcp[1:] = np.minimum(at, width)
    near = np.flatnonzero(at < width)
    for r in range(0, len(near), 8192):
        k = near[r : r + 8192]
        cols = np.minimum(at[k, None] + np.arange(8), width - 1)
        equal = matrix[order[k, None], cols] == matrix[order[k + 1][:, None], cols]
        lcp[1:][k] = np.minimum(at[k] + equal.cumprod(axis=1).sum(axis=1), width)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(lengths[order[:-1]], lengths[order[1:]]))
    return order, lcp


def repeated_windows(rank, left, size, data) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, window start inside it) of every window that an earlier item holds too; `rank` lists the items from the earliest on.

    An item is `size` bytes of a document, with its anchor `left` bytes in.
    """
    n = len(left)
    ends = np.cumsum(size)
    begin = ends - size
    buf = np.frombuffer(data, np.uint8)
    buf = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
    right_len = size - left
    reach = WIDTH - GRAM
    right, before = np.zeros((n, WIDTH), np.uint8), np.zeros((n, reach), np.uint8)
    cols, lcols = np.arange(WIDTH), np.arange(reach)
    for r in range(0, n, 4096):  # the index matrices are wide
        k = slice(r, r + 4096)
        right[k] = np.where(cols < right_len[k, None], buf[np.minimum((begin + left)[k, None] + cols, len(buf) - 1)], 0)
        before[k] = np.where(lcols < left[k, None], buf[np.maximum((begin + left - 1)[k, None] - lcols, 0)], 0)
    r_order, r_lcp = suffix_order(right, right_len)
    l_order, l_lcp = suffix_order(before, left)
    least = np.maximum(0, WIDTH - right_len)  # offsets a of windows: least <= a <= left
    mine_r, mine_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(reach + 1):
        idx = rank[(least[rank] <= a) & (a <= left[rank])]
        if len(idx) < 2:
            continue
        mine_r[r_order] = np.cumsum(r_lcp < WIDTH - a)
        mine_l[l_order] = np.cumsum(l_lcp < a) if a else 0
        key = mine_r[idx] * (n + 1) + mine_l[idx]
        o = np.argsort(key, kind="stable")
        again = o[1:][key[o[1:]] == key[o[:-1]]]
        yield idx[again], left[idx[again]] - a


def range_buckets(leads: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Splitters of the leading bytes for even ranges, and how many buckets each range is dealt over."""
    cuts = np.unique(leads[np.linspace(0, len(leads) - 1, min(buckets, len(leads)) + 1).astype(int)[1:-1]]) if len(leads) else leads
    return cuts, -(-buckets // (len(cuts) + 1))


def _send(corpus: Corpus, buckets: int):
    hot, (splitters, deal) = corpus.hot, range_buckets(corpus.leads, buckets)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts()
        for c in chunks_of(batches):
            if (got := around(c, SHAPE, hot)) is None:
                continue
            s, text, p, first, last = got
            items = np.zeros(len(p), ITEM)
            items["d"], items["h"], items["row"] = c.numbers("d")[text], c.numbers("h")[text], text
            items["at"], items["left"], items["size"] = first - s.starts[text], p - first, last - first + WIDTH
            data = [s.cut(x, x + n) for x, n in zip(first.tolist(), items["size"].tolist(), strict=True)]
            fresh = np.ones(len(p), bool)
            # rows of a chunk are in order, and so are their anchors
            for i, (d, h, row, at, left, _) in enumerate(items.tolist()):  # equal contexts: the earliest goes on, the others are repeats
                fresh[i] = contexts.earlier((data[i], left), (d, h, c.gid, c.sub, row, at)) is None
            gone = np.flatnonzero(~fresh)
            if len(gone):
                yield _record(c.gid % buckets, c, items[gone], None)
            i = np.flatnonzero(fresh)
            to = np.searchsorted(splitters, s.leads(p[i]), "right").astype(np.int64)
            if deal > 1:
                to = to * deal + (s.again(p[i]) % np.uint64(deal)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            for bucket, k in per_text(to[by], i[by]):
                yield _record(bucket, c, items[k], b"".join([data[x] for x in k]))

    return step


def _record(bucket: int, c: Chunk, items: np.ndarray, data: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "gid": [c.gid], "sub": [c.sub], "items": [items.tobytes()], "data": [data]}, schema=_HEAD)


def _compare(_, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items = column(held, "items", ITEM)
    each = [len(x) // ITEM.itemsize for b in held for x in b.column("items").to_pylist()]
    gid = np.repeat(np.concatenate([b.column("gid").to_numpy() for b in held]), each)
    sub = np.repeat(np.concatenate([b.column("sub").to_numpy() for b in held]), each)
    data = [x for b in held for x in b.column("data").to_pylist()]
    known = np.repeat(np.array([x is None for x in data]), each)  # repeats as they stand
    found = [(np.flatnonzero(known), items["at"][known].astype(np.int64), (items["at"] + items["size"])[known].astype(np.int64))]
    rest = np.flatnonzero(~known)
    if len(rest):
        x = items[rest]
        rank = np.lexsort((x["at"], x["row"], sub[rest], gid[rest], x["h"], x["d"]))
        for i, start in repeated_windows(rank, x["left"].astype(np.int64), x["size"].astype(np.int64), b"".join([x for x in data if x is not None])):
            at = x["at"][i] + start
            found.append((rest[i], at, at + WIDTH))
    i, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(i):
        return
    order = np.lexsort((start, items["row"][i], sub[i], gid[i]))
    i, start, end = i[order], start[order], end[order]
    new = np.ones(len(i), bool)
    new[1:] = (gid[i[1:]] != gid[i[:-1]]) | (sub[i[1:]] != sub[i[:-1]]) | (items["row"][i[1:]] != items["row"][i[:-1]])
    at, start, end = merge(np.cumsum(new) - 1, start, end)
    spans = np.zeros(len(at), SPAN)
    i = i[at]
    spans["sub"], spans["row"], spans["start"], spans["end"] = sub[i], items["row"][i], start, end
    yield grouped(gid[i], spans)


def merge(row, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping and touching spans of one row: the first of each and its start and end. Rows are numbered from 0, the input is sorted."""
    if not len(row):
        return row, start, end
    step = int(end.max()) + 1
    top = np.maximum.accumulate(end + row * step) - row * step  # furthest end so far in the row
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > top[:-1])
    at = np.flatnonzero(new)
    return at, start[at], top[np.append(at[1:], len(row)) - 1]


def spans_of(c: Chunk) -> list[np.ndarray]:
    """Maximal removed spans (start, end) of each row of a chunk."""
    out = [np.empty((0, 2), np.int64)] * c.batch.num_rows
    s = np.concatenate([np.frombuffer(b, SPAN) for b in c.lists]) if c.lists else np.empty(0, SPAN)
    s = s[s["sub"] == c.sub]
    s = s[np.lexsort((s["start"], s["row"]))]
    for row, x in per_text(s["row"], s):
        _, a, z = merge(np.zeros(len(x), np.int64), x["start"].astype(np.int64), x["end"].astype(np.int64))
        out[row] = np.column_stack([a, z])
    return out


def removed_spans(docs: DataFrame, *others: str) -> DataFrame:
    """The documents (gid, d, h, text, and `rest` with other columns) with `lists`, of which spans_of reads the removed spans."""
    corpus = Corpus(docs, SHAPE, *others)
    around_ = corpus.with_lists(corpus.repeated()).select("gid", "d", "h", "text", "lists")
    items = around_.mapInArrow(_send(corpus, corpus.buckets), _DDL)
    spans = items.repartition(corpus.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(_compare), "gid long, found binary")
    return corpus.with_lists(spans.groupBy("gid").agg(F.collect_list("found").alias("lists")))


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, z in spans.tolist():
        parts.append(text[at:a])
        at = z
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without the parts of characters at their edges."""
    out = []
    for a, z in spans.tolist():
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return np.array(out, np.int64).reshape(-1, 2)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            rows = []
            for d, t, s in zip(c.numbers("d").tolist(), c.texts(), spans_of(c), strict=True):
                rows.append((None if d == NO_ID else d, len(t), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(kept_bytes(t, s)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return removed_spans(docs).mapInArrow(step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings, cut at whole characters; those left empty go. Same columns."""
    names, docs = docs.columns, renamed(docs, "doc_id", "text", "n_chars")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    spans = removed_spans(docs, *others)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            texts = c.texts()
            out = [kept_bytes(t, whole_characters(t, s)).decode("utf-8", "replace") for t, s in zip(texts, spans_of(c), strict=True)]
            keep = [bool(x) or not t for x, t in zip(out, texts, strict=True)]
            b = c.batch.drop_columns(["lists"])
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type)).filter(pa.array(keep, pa.bool_()))

    new = spans.mapInArrow(step, spans.drop("lists").schema)
    whole = {"doc_id": F.when(F.col("d") != NO_ID, F.col("d")).cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in others:
        whole["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return new.select(*[(whole[c] if c in whole else F.col("rest")[c]).alias(c) for c in docs.columns]).toDF(*names)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    """The same in SQL, by the first start of every window; for tables whose doc_ids differ."""
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id::BIGINT AS doc_id, hex(coalesce(text, '')) AS x FROM documents),
win AS (SELECT r, i, substring(x, 2 * i + 1, {2 * WIDTH}) AS g FROM (SELECT r, x, unnest(range(0, len(x) // 2 - {WIDTH - 1})) AS i FROM d WHERE len(x) >= {2 * WIDTH})),
late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY r, i) AS n FROM win) WHERE n > 1),
edge AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {WIDTH}, true) AS new FROM late),
span AS (SELECT r, min(i) AS a, max(i) + {WIDTH} AS z FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM edge) GROUP BY r, k),
cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM span),
kept AS (SELECT r, sum(z - a) AS gone, count(*) AS n, max(z) AS last, string_agg(substring(any_x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head FROM (SELECT cut.*, d.x AS any_x FROM cut JOIN d USING (r)) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substring(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
