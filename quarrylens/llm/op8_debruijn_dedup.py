"""Removal of repeated 13-word strings by compaction of a De Bruijn graph of the corpus.

Edges are 13-word windows, nodes the 12 words that two successive windows share. The graph is partitioned by nodes: runs
of nodes with one anchor (see `repeats`) travel together, as the words they cover and one more on either side, so that
all edges of a node meet in its anchor's bucket. A bucket numbers its distinct edges and counts how many enter and leave
each node; edges around nodes with one of either compact, by pointer doubling, into unbranched paths; an edge between two
buckets is in both and ends a path in each. Occurrences of paths in later documents are written with the coordinates of
the first document that has their edges, and every edge is compared with the words at its source, byte for byte.

The paths are joined to their documents by Spark, where those that share an edge or meet in a node, and whose source
coordinates go on alike, are united to long repeated spans, however many buckets and branches they went through.

`repeated_paths` gives the spans, `digest` the contract's columns. Defined results: a null text has no words; texts of
fewer than 13 words lose nothing; "earlier" is a smaller doc_id, rows with one doc_id do not remove from each other; a
null doc_id counts as the smallest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import NO_ID, Chunk, Contexts, Corpus, Shape, around, by_bucket, chunks_of, column, grouped, per_text
from .textnp import gram_hashes, inside_texts, join_texts, word_hashes, words

WIDTH, GRAM = 13, 5
NODE = WIDTH - 1
SHAPE = Shape(NODE, GRAM, by_word=True)
BUCKET_BYTES = 2 << 20
_HEAD = pa.schema([("bucket", pa.int32()), ("gid", pa.int64()), ("sub", pa.int32()), ("known", pa.bool_()), ("items", pa.binary()), ("data", pa.binary())])
_DDL = "bucket int, gid long, sub int, known boolean, items binary, data binary"
#: An item: a row of its chunk and `size` words of it from word `at` on; `nodes` nodes from the word `skip` of these on belong to the bucket.
ITEM = np.dtype([("d", "<i8"), ("row", "<i4"), ("at", "<i4"), ("skip", "i1"), ("nodes", "<i2"), ("size", "<i2")])
#: A path: `n` edges of a row from word `at` on, and the document and word where they stand first.
PATH = np.dtype([("sub", "<i4"), ("row", "<i4"), ("at", "<i4"), ("n", "<i4"), ("source_at", "<i4"), ("source", "<i8")])


def _send(corpus: Corpus):
    hot, buckets = corpus.hot, corpus.buckets

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts()
        for c in chunks_of(batches):
            if (got := around(c, SHAPE, hot)) is None:
                continue
            s, text, p, first, last = got
            start = np.maximum(first - 1, s.starts[text])
            end = np.minimum(last + WIDTH, s.starts[text + 1])
            items = np.zeros(len(p), ITEM)
            items["d"], items["row"], items["at"] = c.numbers("d")[text], text, start - s.starts[text]
            items["skip"], items["nodes"], items["size"] = first - start, last - first + 1, end - start
            keep = np.flatnonzero(end - start >= WIDTH)
            items, p, start, end = items[keep], p[keep], start[keep], end[keep]
            data = [s.cut(x, z) for x, z in zip(start.tolist(), end.tolist(), strict=True)]
            known, paths = np.zeros(len(items), bool), []
            for i, (d, row, at, skip, nodes, size) in enumerate(items.tolist()):
                was = contexts.earlier((data[i], skip, nodes), (d, c.gid, c.sub, row, at))
                if was is not None and was[0] < d:  # equal to one of an earlier document: a path as it stands
                    known[i] = True
                    paths.append((c.sub, row, at, size - NODE, was[4], was[0]))
            if paths:
                yield _record(c.gid % buckets, c, True, np.array(paths, PATH), None)
            i = np.flatnonzero(~known)
            to = (s.keys(p[i]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            for bucket, k in per_text(to[by], i[by]):
                yield _record(bucket, c, False, items[k], b"\n".join([data[x] for x in k]))

    return step


def _record(bucket: int, c: Chunk, known: bool, items: np.ndarray, data: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "gid": [c.gid], "sub": [c.sub], "known": [known], "items": [items.tobytes()], "data": [data]}, schema=_HEAD)


def edge_numbers(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each window of `width` words (from word `at` on) among the distinct ones, and the first window of each number.

    Hashes group the windows; each is then compared with the first of its group. Should two different ones have one
    hash, the words themselves are the keys.
    """
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if not same_words(data, lo, hi, at, at[first[number]], width):
        ids: dict[bytes, int] = {}
        number = np.array([ids.setdefault(b" ".join([data[lo[x] : hi[x]].tobytes() for x in range(a, a + width)]), len(ids)) for a in at.tolist()])
        _, first = np.unique(number, return_index=True)
    return number, first


def same_words(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> bool:
    """Whether the `width` words from each of `a` on are those from `b` on, byte for byte; successive windows are compared as one run."""
    differ = np.flatnonzero(a != b)
    if not len(differ):
        return True
    o = differ[np.argsort(a[differ], kind="stable")]
    a, b = a[o], b[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(a))) + width - 1
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    a, b = np.repeat(a[first], count) + step, np.repeat(b[first], count) + step
    n = hi[a] - lo[a]
    if not np.array_equal(n, hi[b] - lo[b]):
        return False
    for r in range(0, len(a), 1 << 16):
        k = slice(r, r + (1 << 16))
        step = np.arange(int(n[k].sum())) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        if not np.array_equal(data[np.repeat(lo[a[k]], n[k]) + step], data[np.repeat(lo[b[k]], n[k]) + step]):
            return False
    return True


def unbranched(left: np.ndarray, right: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Path of each edge (left node, right node) and its place on it.

    Two edges follow each other on a path where the node between is the bucket's own, one edge enters it and one leaves.
    Pointers to the edge before double until all reach the first edge of their path; a ring is cut at its least edge.
    """
    n = len(left)
    into, out = np.bincount(right, minlength=len(own)), np.bincount(left, minlength=len(own))
    open_ = own & (into == 1) & (out == 1)
    enters = np.full(len(own), -1)
    enters[right] = np.arange(n)
    before = np.where(open_[left], enters[left], np.arange(n))
    before, steps, least = before.copy(), (before != np.arange(n)).astype(np.int64), np.minimum(before, np.arange(n))
    jump, low = before.copy(), least.copy()
    for _ in range(n.bit_length()):  # the least edge that leads here; on a ring all edges do
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    ring = jump != before[jump]
    cut = np.flatnonzero(ring & (low == np.arange(n)))
    before[cut], steps[cut] = cut, 0
    while True:
        nxt = before[before]
        if np.array_equal(nxt, before):
            return before, steps
        steps = steps + steps[before]
        before = nxt


def compact(place: list[np.ndarray], path: np.ndarray, step: np.ndarray, source: np.ndarray, source_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First of each run of occurrences (in order of place and at) that follow one path and one source, and how many they are."""
    new = np.ones(len(at), bool)
    go_on = (at[1:] == at[:-1] + 1) & (path[1:] == path[:-1]) & (step[1:] == step[:-1] + 1) & (source[1:] == source[:-1]) & (source_at[1:] == source_at[:-1] + 1)
    for x in place:
        go_on &= x[1:] == x[:-1]
    new[1:] = ~go_on
    return np.flatnonzero(new)


def _bucket(_, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready = [b.filter(b.column("known")) for b in held]
    for b in ready:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("items")], ["gid", "found"])
    held = [x for b in held if (x := b.filter(pc.invert(b.column("known")))).num_rows]
    if not held:
        return
    items = column(held, "items", ITEM)
    each = [len(x) // ITEM.itemsize for b in held for x in b.column("items").to_pylist()]
    gid = np.repeat(np.concatenate([b.column("gid").to_numpy() for b in held]), each)
    sub = np.repeat(np.concatenate([b.column("sub").to_numpy() for b in held]), each)
    data, _ = join_texts([x for b in held for x in b.column("data").to_pylist()])
    lo, hi, _ = words(data, np.array([0, len(data)]))
    h = word_hashes(data, lo, hi)
    first = np.concatenate([[0], np.cumsum(items["size"], dtype=np.int64)])
    at = np.flatnonzero(inside_texts(first, WIDTH))  # edges, by their first word
    item = np.searchsorted(first, at, "right") - 1
    pos = items["at"][item] + at - first[item]
    d, g, u, r = items["d"][item], gid[item], sub[item], items["row"][item]
    o = np.lexsort((pos, r, u, g, d))
    at, item, pos, d, g, u, r = (x[o] for x in (at, item, pos, d, g, u, r))
    edge, head = edge_numbers(data, lo, hi, at, WIDTH, gram_hashes(h, WIDTH)[at])
    late = np.flatnonzero(d != d[head[edge]])
    if not len(late):
        return
    # nodes of the distinct edges; one is the bucket's own if some item says so
    node, _ = edge_numbers(data, lo, hi, np.concatenate([at[head], at[head] + 1]), NODE, gram_hashes(h, NODE)[np.concatenate([at[head], at[head] + 1])])
    left, right = node[: len(head)], node[len(head) :]
    x = items[item]
    off = at - first[item]
    inside = lambda k: (k >= x["skip"]) & (k < x["skip"] + x["nodes"])
    own = np.zeros(int(node.max()) + 1, bool)
    own[left[edge[inside(off)]]] = True
    own[right[edge[inside(off + 1)]]] = True
    path, step = unbranched(left, right, own)
    o = late[np.lexsort((pos[late], r[late], u[late], g[late]))]
    src = head[edge[o]]
    i = compact([g[o], u[o], r[o]], path[edge[o]], step[edge[o]], d[src], pos[src], pos[o])
    n = np.diff(np.append(i, len(o)))
    o, src = o[i], src[i]
    out = np.zeros(len(o), PATH)
    for name, v in zip(PATH.names, (u[o], r[o], pos[o], n, pos[src], d[src]), strict=True):
        out[name] = v
    yield grouped(g[o], out)


def spans_of(c: Chunk) -> np.ndarray:
    """Long repeated spans (as paths) of a chunk, by row: paths that share an edge or a node and go on alike at their source."""
    p = np.concatenate([np.frombuffer(b, PATH) for b in c.lists]) if c.lists else np.empty(0, PATH)
    p = p[p["sub"] == c.sub]
    if len(p) < 2:
        return p
    shift = p["source_at"].astype(np.int64) - p["at"]
    o = np.lexsort((p["at"], shift, p["source"], p["row"]))
    p, shift = p[o].copy(), shift[o]
    new = np.ones(len(p), bool)
    new[1:] = (p["row"][1:] != p["row"][:-1]) | (p["source"][1:] != p["source"][:-1]) | (shift[1:] != shift[:-1])
    line = np.cumsum(new) - 1
    far = int((p["at"] + p["n"]).max()) + 1
    top = np.maximum.accumulate(p["at"] + p["n"] + line * far) - line * far
    new[1:] |= p["at"][1:] > top[:-1]
    i = np.flatnonzero(new)
    out = p[i]
    out["n"] = top[np.append(i[1:], len(p)) - 1] - out["at"]
    return out[np.lexsort((out["at"], out["row"]))]


def _joined(docs: DataFrame) -> DataFrame:
    corpus = Corpus(docs, SHAPE, bucket_bytes=BUCKET_BYTES)
    edges = corpus.with_lists(corpus.repeated()).mapInArrow(_send(corpus), _DDL)
    paths = edges.repartition(corpus.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(_bucket), "gid long, found binary")
    return corpus.with_lists(paths.groupBy("gid").agg(F.collect_list("found").alias("lists")))


def _id(d: int) -> int | None:
    return None if d == NO_ID else d


def repeated_paths(docs: DataFrame) -> DataFrame:
    """One row for each long repeated span: doc_id, first_word, n_words, source_doc_id, source_word."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "first_word", "n_words", "source_doc_id", "source_word")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            d = c.numbers("d").tolist()
            rows = [(_id(d[p["row"]]), int(p["at"]), int(p["n"]) + NODE, _id(int(p["source"])), int(p["source_at"])) for p in spans_of(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], schema=schema)

    return _joined(docs).mapInArrow(step, ", ".join(f"{f.name} long" for f in schema))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            spans, rows = {}, []
            p = spans_of(c)
            for row, x in per_text(p["row"], p):
                spans[row] = list(zip(x["at"].tolist(), (x["at"] + x["n"] + NODE).tolist(), strict=True))
            for row, (d, t) in enumerate(zip(c.numbers("d").tolist(), c.texts(), strict=True)):
                ws = t.split()
                kept, at = [], 0
                for a, z in spans.get(row, ()):
                    kept += ws[at:a]
                    at = max(at, z)
                kept += ws[at:]
                rows.append((_id(d), len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return _joined(docs).mapInArrow(step, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    """The same in SQL, by the first document of every window."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, coalesce(doc_id, {NO_ID}) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, k, i, array_to_string(list_slice(ws, i, i + {NODE}), ' ') AS g FROM (SELECT r, k, ws, unnest(generate_series(1, len(ws) - {NODE})) AS i FROM d WHERE len(ws) >= {WIDTH})),
late AS (SELECT r, i FROM (SELECT r, k, i, min(k) OVER (PARTITION BY g) AS first FROM win) WHERE first < k),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + {NODE})) AS i FROM late),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
