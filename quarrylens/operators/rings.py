"""Strongly connected components and import cycles.

Unbranched stretches of the graph are first contracted by pointer doubling: a file with one way in and one way out is inside a
chain, and in each round its pointer jumps twice as far. So a ring or chain of any length takes as many rounds as its
length has binary digits, and breadth-first rounds count branchings only. No step depends on the graph's size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import reach

#: Rounds of colours, and steps of each, in which a task puts neighbouring files together.
COLOURS, STEPS = 3, 64


@dataclass
class Contracted:
    #: src, dst, w (edges), first, last: links between files that stay; first and last file of the chain, null for an edge.
    links: DataFrame
    #: v, to, last, steps: files inside chains, with the file behind the chain, the chain's last one and the way there.
    inside: DataFrame
    #: v, least: files of rings that no other file touches, with the ring's least one.
    rings: DataFrame


def contract(edges: DataFrame, stay: DataFrame | None = None) -> Contracted:
    """Chains of files with one way in and one way out become links. edges: distinct src, dst; stay: v of files never inside."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"), F.min("dst").alias("to"))
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"))
    mid = out.join(into, "v").filter("o = 1 and i = 1").select("v", "to")
    mid = written(mid if stay is None else mid.join(stay.select("v"), "v", "left_anti"))
    if mid.isEmpty():
        none = F.lit(None).cast("long")
        return Contracted(edges.select("src", "dst", F.lit(1).cast("long").alias("w"), none.alias("first"), none.alias("last")), mid.select("v", "to", F.col("v").alias("last"), F.lit(1).cast("long").alias("steps")), mid.select("v", F.col("v").alias("least")))
    start = mid.join(mid.select(F.col("v").alias("to"), F.lit(True).alias("open")), "to", "left")
    jump = written(start.select("v", "to", F.col("v").alias("last"), F.lit(1).cast("long").alias("steps"), F.col("v").alias("least"), F.coalesce("open", F.lit(False)).alias("open")))
    done, before = jump.filter("not open"), None
    left = jump.filter("open")
    while True:
        # both halves of the table are read as they were: pointers of this round start from those of the round before
        all_ = left.unionByName(done)
        ahead = all_.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("steps").alias("s2"), F.col("least").alias("l2"), F.col("open").alias("open2"))
        new = left.join(ahead, "to").select("v", F.col("to2").alias("to"), F.col("last2").alias("last"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("least", "l2").alias("least"), F.col("open2").alias("open"), (F.col("l2") < F.col("least")).alias("less"))
        new = written(new)
        n = new.agg(F.count_if("open").alias("open"), F.count_if(F.col("open") & F.col("less")).alias("less")).first()
        done, left = done.unionByName(new.filter("not open").drop("less")), new.filter("open").drop("less")
        if not n["open"] or (n["open"] == before and not n["less"]):
            break  # what is still open goes round and round
        before = n["open"]
    done = written(done.select("v", "to", "last", "steps"))
    heads = edges.join(mid.select(F.col("v").alias("src")), "src", "left_anti")
    links = heads.join(done.select(F.col("v").alias("dst"), "to", "last", "steps"), "dst", "left")
    links = links.select("src", F.coalesce("to", "dst").alias("dst"), (F.coalesce("steps", F.lit(0)) + 1).alias("w"), F.when(F.col("to").isNotNull(), F.col("dst")).alias("first"), "last")
    return Contracted(written(links), done, left.select("v", "least"))


def _grow(start: DataFrame, step) -> DataFrame:
    """Repeat step until nothing is new; rows are distinct."""
    known = frontier = written(start)
    while True:
        frontier = written(step(frontier).join(known, known.columns, "left_anti").distinct())
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Each file takes the largest colour among its own and those of the files that lead to it."""
    best = edges.join(colours, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("m"))
    return colours.join(best, "v", "left").select("v", F.greatest("c", F.coalesce("m", "c")).alias("c"))


def _trim(left: DataFrame) -> tuple[DataFrame, int]:
    """Edges of files that have a way in and a way out, and their number."""
    before = -1
    while (n := left.count()) != before and n:
        before = n
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi"))
    return left, n


def _lowest(words: list[Column]) -> Column:
    """Number of the lowest bit that is set."""
    bit = lambda w: F.when(w == F.lit(-(2**63)), 63).otherwise(F.bit_count(F.bitwise_not(w).bitwiseAND(w - 1)))
    return F.coalesce(*[F.when(w != 0, bit(F.when(w != 0, w)) + i * reach.WORD) for i, w in enumerate(words)])


def _by_pivots(edges: DataFrame) -> DataFrame:
    """(v, c) of the components that hold one of the LANES files with most ways through: reached from a pivot, and reaching it."""
    ways = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o")).join(edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i")), "v")
    pivots = ways.orderBy(F.desc(F.col("o") * F.col("i")), "v").limit(reach.LANES).select(F.col("v").alias("file_id"))
    lanes = reach.start_blocks(pivots)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead, back = (reach.merged(reach.levels(e, lanes)) for e in (edges, turned))
    words = reach.WORD_COLUMNS
    both = ahead.join(back.withColumnsRenamed({w: f"b_{w}" for w in words}), ["file_id", "block"])
    lane = _lowest([F.col(w).bitwiseAND(F.col(f"b_{w}")) for w in words])
    lane = written(both.select(F.col("file_id").alias("v"), lane.alias("lane"))).filter("lane is not null")
    return lane.join(lanes.select("lane", F.col("file_id").alias("c")), "lane").select("v", "c")


def _cores(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Files of src, and for each one that it reaches and is reached from by these edges, itself mostly if there is no other.

    Largest ids spread along the edges, then each that came back to its file goes the other way. Steps are few; what they leave apart stays apart here.
    """
    ids = np.unique(src)
    b = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    held = ids[b] == dst
    a, b = np.searchsorted(ids, src[held]), b[held]
    group, free = np.arange(len(ids)), np.ones(len(ids), bool)
    heads = lambda x: np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    for _ in range(COLOURS):
        live = free[a] & free[b]
        a, b = a[live], b[live]
        if not len(a):
            break
        order = np.argsort(b, kind="stable")
        x, y = a[order], b[order]
        first, colour = heads(y), np.arange(len(ids))
        for _ in range(STEPS):
            new = np.maximum(np.maximum.reduceat(colour[x], first), colour[y[first]])
            if (new == colour[y[first]]).all():
                break
            colour[y[first]] = new
        same = colour[a] == colour[b]
        order = np.argsort(a[same], kind="stable")
        x, y = a[same][order], b[same][order]
        member = free & (colour == np.arange(len(ids)))
        first = heads(x) if len(x) else x
        for _ in range(STEPS if len(x) else 0):
            new = np.logical_or.reduceat(member[y], first) | member[x[first]]
            if (new == member[x[first]]).all():
                break
            member[x[first]] = new
        group[member] = colour[member]
        free &= ~member
    return ids, ids[group]


def _shrunk(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, c): files that edges between near ids show to be on a cycle with c; and the distinct edges between what is left.

    A task takes neighbouring files and at most HELD of their edges at a time. It need not find all: where ids say nothing about
    who imports whom, little is put together, and the steps that follow do the rest.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, n = (), [], 0  # the last file and its group

        def put() -> Iterator[pa.RecordBatch]:
            nonlocal last
            src, dst = (np.concatenate(x) for x in zip(*rows, strict=True))
            again = src == last[0] if last else np.zeros(len(src), bool)  # its group is given already
            out = [(np.full(again.sum(), last[1]), dst[again], True)] if again.any() else []
            src, dst = src[~again], dst[~again]
            if len(src):
                ids, group = _cores(src, dst)
                last = (ids[-1], group[-1])
                met, size = np.unique(group, return_counts=True)
                big = size[np.searchsorted(met, group)] > 1
                a, k = group[np.searchsorted(ids, src)], np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
                b = np.where(ids[k] == dst, group[k], dst)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = (a != b) & np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                out += [(ids[big], group[big], False), (a[new], b[new], True)]
            for a, b, edge in out:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), edge))], names=["a", "b", "edge"])

        for batch in batches:
            if batch.num_rows:
                rows.append((batch["src"].to_numpy(), batch["dst"].to_numpy()))
                n += batch.num_rows
            if n >= reach.HELD:
                yield from put()
                rows, n = [], 0
        if rows:
            yield from put()

    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = written(edges.repartitionByRange(parts, "src").sortWithinPartitions("src").mapInArrow(shrink, "a long, b long, edge boolean"))
    group = rows.filter("not edge").select(F.col("a").alias("v"), F.col("b").alias("c"))
    left = rows.filter("edge").select(F.col("a").alias("src"), F.col("b").alias("v")).join(group, "v", "left").select("src", F.coalesce("c", "v").alias("dst"))
    return group, written(left.filter("src <> dst").distinct())


def _plain(edges: DataFrame) -> DataFrame:
    return written(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(file_id, component) of files on a cycle with another file: strongly connected components of two or more; the least id names one.

    Files with near ids that reach each other over such files are one file from the start. Chains are contracted and files without
    a way in or out trimmed. Reach from and to pivots finds the large components. The rest is coloured: every file takes the
    largest id that reaches it; what the colour's root can be reached from, within the colour, is a component; repeat.
    """
    return _components(_plain(edges))


def _components(edges: DataFrame) -> DataFrame:
    """edges: distinct, without loops."""
    group, left = _shrunk(edges)
    whole = written(_whole_components(left))
    of = group.join(whole.withColumnRenamed("file_id", "c"), "c", "left").select("v", F.coalesce("component", "c").alias("c"))
    found = of.unionByName(whole.join(group.select(F.col("v").alias("file_id")), "file_id", "left_anti").select(F.col("file_id").alias("v"), F.col("component").alias("c")))
    least = found.groupBy("c").agg(F.min("v").alias("component"))
    return found.join(least, "c").select(F.col("v").alias("file_id"), "component")


def _whole_components(plain: DataFrame) -> DataFrame:
    """As strong_components, of distinct edges without loops, whatever their ids."""
    small = contract(plain)
    left, n = _trim(written(small.links.filter("src <> dst").select("src", "dst").distinct()))
    parts = [small.links.filter("src = dst").select(F.col("src").alias("v"), F.col("src").alias("c"))]
    if n:
        parts.append(written(_by_pivots(left)))
        gone = parts[-1].select("v")
        left, n = _trim(written(left.join(gone, F.col("src") == F.col("v"), "left_anti").join(gone, F.col("dst") == F.col("v"), "left_anti")))
    while n:
        nodes = left.select(F.col("src").alias("v")).unionByName(left.select(F.col("dst").alias("v"))).distinct()
        colours, changed = written(nodes.withColumn("c", F.col("v"))), 1
        while changed:
            new = _spread(left, _spread(left, colours))  # two steps for each write
            new = written(new.join(colours.withColumnRenamed("c", "old"), "v"))
            changed = new.filter("c > old").count()
            colours = new.select("v", "c")
        inside = written(left.join(colours.withColumnsRenamed({"v": "src", "c": "cs"}), "src").join(colours.withColumnsRenamed({"v": "dst", "c": "cd"}), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        into = inside.select(F.col("dst").alias("v"), "c", "src")
        member = _grow(colours.filter("v = c"), lambda f, into=into: f.join(into, ["v", "c"]).select(F.col("src").alias("v"), "c"))
        parts.append(member)
        gone = member.select("v")
        left, n = _trim(written(left.join(gone, F.col("src") == F.col("v"), "left_anti").join(gone, F.col("dst") == F.col("v"), "left_anti")))
    ends = functools.reduce(DataFrame.unionByName, parts[1:] + parts[:1]).groupBy("v").agg(F.max_by("c", F.when(F.col("c") == F.col("v"), 0).otherwise(1)).alias("c"))
    ends = written(ends)
    side = lambda k: ends.select(F.col("v").alias(k), F.col("c").alias(f"c_{k}"))
    closed = small.links.join(side("src"), "src").join(side("dst"), "dst").filter("c_src = c_dst and last is not null").select("last", F.col("c_src").alias("c"))
    chain = small.inside.join(closed, "last").select("v", "c")
    # labels of contracted components are files that stay; rings have files of their own
    found = ends.unionByName(chain).unionByName(small.rings.select("v", F.col("least").alias("c")))
    size = found.groupBy("c").agg(F.min("v").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return found.join(size, "c").select(F.col("v").alias("file_id"), "component")


def _packed(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links that are edges, as src and dst (an array); the others, if any, as they are."""
    chained = links.filter("last is not null")
    return reach.imports_of(links.filter("last is null")), None if chained.isEmpty() else written(chained)


def _paths(packed: DataFrame, chained: DataFrame | None, roots: DataFrame, name: str) -> DataFrame:
    """(v, <name>_n, <name>_c): the breadth-first way from the root to v: its files, and the chain that leads to each.

    Of several files one step nearer to the root the least is the parent; it is found with the distance, in one pass. Ways are
    put together by doubling: each way's beginning is replaced by the whole way there.
    """
    step = F.struct("d", "key", "up", "c").alias("t")
    none = F.lit(None).cast("long")
    known = frontier = written(roots.select("v", F.struct(F.lit(0).cast("long").alias("d"), none.alias("key"), none.alias("up"), none.alias("c")).alias("t")))
    while True:
        at = frontier.select(F.col("v").alias("src"), F.col("t.d").alias("ds"))
        near = at.join(packed, "src").select(F.explode("dst").alias("v"), (F.col("ds") + 1).alias("d"), "src").groupBy("v", "d").agg(F.min("src").alias("up"))
        near = near.select("v", "d", F.col("up").alias("key"), "up", none.alias("c"))
        if chained is not None:
            near = near.unionByName(at.join(chained, "src").select(F.col("dst").alias("v"), (F.col("ds") + F.col("w")).alias("d"), F.col("last").alias("key"), F.col("src").alias("up"), "c"))
        near = near.select("v", step).groupBy("v").agg(F.min("t").alias("t")).join(known.withColumnRenamed("t", "old"), "v", "left").filter("old is null or t < old")
        new = written(near.select("v", "t", F.expr("old is null or t.d < old.d").alias("nearer")))
        if new.isEmpty():
            break
        # a parent that only has a lesser id changes no distance, so its files do not go on
        frontier, known = new.filter("nearer").select("v", "t"), written(known.unionByName(new.select("v", "t")).groupBy("v").agg(F.min("t").alias("t")))
    done = written(roots.select("v", F.array("v").alias("n"), F.array(none).alias("c")))
    left = written(known.filter("t.d > 0").select("v", F.col("t.up").alias("up"), F.array("v").alias("n"), F.array("t.c").alias("c")))
    while not left.isEmpty():
        whole = done.select(F.col("v").alias("up"), F.col("n").alias("hn"), F.col("c").alias("hc"), none.alias("up2"))
        ahead = whole.unionByName(left.select(F.col("v").alias("up"), F.col("n").alias("hn"), F.col("c").alias("hc"), F.col("up").alias("up2")))
        new = written(left.join(ahead, "up").select("v", F.col("up2").alias("up"), F.concat("hn", "n").alias("n"), F.concat("hc", "c").alias("c")))
        done, left = done.unionByName(new.filter("up is null").select("v", "n", "c")), new.filter("up is not null")
    return done.withColumnsRenamed({"n": f"{name}_n", "c": f"{name}_c"})


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """component, ring, chains (the chain behind each file of the ring) of links with the ways out to src and up from dst; no row waits for another."""
    kind = pa.list_(pa.int64())
    schema = pa.schema([("component", pa.int64()), ("ring", kind), ("chains", kind)])
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        u, o = batch["up_n"].flatten().to_numpy(), batch["out_n"].flatten().to_numpy()
        lu, lo = (batch[c].value_lengths().to_numpy().astype(np.int64) for c in ("up_n", "out_n"))
        end_u, end_o = np.cumsum(lu), np.cumsum(lo)
        row = np.arange(rows)
        ids, at = np.unique(np.concatenate((u, o)), return_inverse=True)
        ku, ko = np.repeat(row, lu) * len(ids) + at[: len(u)], np.repeat(row, lo) * len(ids) + at[len(u) :]
        order = np.argsort(ko, kind="stable")
        there = order[np.minimum(np.searchsorted(ko, ku, sorter=order), len(ko) - 1)]
        # the last file of the way up that is on the way out, too; the root is on both
        x = np.maximum.reduceat(np.where(ko[there] == ku, np.arange(len(u)), -1), end_u - lu)
        y, k = there[x], end_u - 1 - x
        size = k + end_o - y
        ends = np.cumsum(size)
        own, start = np.repeat(row, size), ends - size
        j = np.arange(ends[-1]) - start[own]
        place = lambda j: np.where(j < k[own], end_u[own] - 1 - j, len(u) + y[own] + j - k[own])
        both = np.concatenate((u, o))
        files = both[place(j)]
        first = np.flatnonzero(files == np.minimum.reduceat(files, start)[own]) - start
        at = place((j + first[own]) % size[own])
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        if batch["close"].null_count == rows and batch["up_c"].flatten().null_count == len(u) and batch["out_c"].flatten().null_count == len(o):
            chains = pa.nulls(rows, kind)
        else:
            # behind a file of the way out comes the chain of the next one, behind src that of the link itself
            links = pa.concat_arrays([batch["up_c"].flatten(), batch["out_c"].flatten(), batch["close"]])
            nth = np.where(at < len(u), at, np.where(at - len(u) + 1 < end_o[own], at + 1, len(u) + len(o) + own))
            chains = pa.ListArray.from_arrays(offsets, links.take(pa.array(nth)))
        yield pa.RecordBatch.from_arrays([pa.array(o[end_o - lo]), pa.ListArray.from_arrays(offsets, pa.array(both[at])), chains], schema=schema)


def _rotated(items: Column, ids: Column) -> Column:
    k = F.array_position(ids, F.array_min(ids)).cast("int")
    return F.concat(F.slice(items, k, F.size(items)), F.slice(items, F.lit(1), k - 1))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, cycle): canonical import cycles, one for each import inside a strongly connected component.

    The import a -> b is closed by the breadth-first path from b to the component's least file and on from there to a,
    cut short where the two first meet. Cycles start at their least id; equal ones are given once. So every import that
    is on a cycle is in one of the result, and there are at most as many cycles as imports. All imports of a chain have one
    cycle: it is found once, as links, and its files are put in at the end.
    """
    plain = _plain(edges)
    comp = written(_components(plain))
    side = lambda k: comp.select(F.col("file_id").alias(k), F.col("component").alias(f"c_{k}"))
    inner = written(plain.join(side("src"), "src").join(side("dst"), "dst").filter("c_src = c_dst").select("src", "dst"))
    roots = written(comp.select(F.col("component").alias("v")).distinct())
    small = contract(inner, roots)
    links = small.links.select("src", "dst", "w", "last", F.col("last").alias("c"))
    turned = small.links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.col("first").alias("last"), F.col("last").alias("c"))
    packed, chained = _packed(links)
    nodes = written(_paths(packed, chained, roots, "out").join(_paths(*_packed(turned), roots, "up"), "v"))
    before = lambda name: (F.try_element_at(f"{name}_n", F.lit(-2)).alias(f"{name}_before"), F.element_at(f"{name}_c", -1).alias(f"{name}_chain"))
    ahead = nodes.select(F.col("v").alias("src"), "out_n", "out_c", *before("up"))
    back = nodes.select(F.col("v").alias("dst"), "up_n", "up_c", *before("out"))
    ways, none = ("out_n", "out_c", "up_n", "up_c"), F.lit(None).cast("long")
    whole = packed.join(ahead, "src").select("src", F.explode("dst").alias("dst"), none.alias("close"), "out_n", "out_c", "up_before", "up_chain")
    if chained is not None:
        whole = whole.unionByName(chained.select("src", "dst", F.col("c").alias("close")).join(ahead, "src"))
    # The ring of a link outside both trees has no other such link, so no other link has that ring: only rings of tree links can be equal.
    in_tree = (F.col("up_before").eqNullSafe(F.col("dst")) & F.col("up_chain").eqNullSafe(F.col("close"))) | (F.col("out_before").eqNullSafe(F.col("src")) & F.col("out_chain").eqNullSafe(F.col("close")))
    others = whole.join(back, "dst").filter(~in_tree).select("close", *ways)
    tree = ahead.select("src", F.col("up_before").alias("dst"), F.col("up_chain").alias("close")).unionByName(back.select(F.col("out_before").alias("src"), "dst", F.col("out_chain").alias("close")))
    tree = tree.filter("src is not null and dst is not null").distinct().join(ahead.select("src", "out_n", "out_c"), "src").join(back.select("dst", "up_n", "up_c"), "dst").select("close", *ways)
    kind = "component long, ring array<long>, chains array<long>"
    ring = others.mapInArrow(_closed, kind).unionByName(tree.mapInArrow(_closed, kind).distinct())
    if chained is None:
        return ring.select("component", F.col("ring").alias("cycle"))
    ring = written(ring.withColumn("id", F.monotonically_increasing_id()))
    is_chained = F.exists(F.coalesce("chains", F.array(none)), lambda c: c.isNotNull())
    chains = small.inside.groupBy(F.col("last").alias("c")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("s"), "v"))), lambda t: t["v"]).alias("files"))
    each = ring.filter(is_chained).select("id", "component", F.posexplode(F.arrays_zip("ring", "chains")).alias("k", "x")).select("id", "component", "k", F.col("x.ring").alias("n"), F.col("x.chains").alias("c")).join(chains, "c", "left")
    part = F.struct("k", F.concat(F.array("n"), F.coalesce("files", F.array().cast("array<bigint>"))).alias("files"))
    filled = each.groupBy("id", "component").agg(F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda t: t["files"])).alias("cycle"))
    return filled.select("component", _rotated(F.col("cycle"), F.col("cycle")).alias("cycle")).unionByName(ring.filter(~is_chained).select("component", F.col("ring").alias("cycle")))
