"""Rows as cells of a regular mesh (row-major): coordinates, lines, blocks, connected components, slabs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strides(shape: list[int]) -> list[int]:
    return [reduce(lambda a, b: a * b, shape[i + 1 :], 1) for i in range(len(shape))]


def coordinates(cell: Column, shape: list[int]) -> list[Column]:
    return [(F.floor(cell / s) % n).cast("long").alias(f"c{i}") for i, (s, n) in enumerate(zip(strides(shape), shape))]


def with_coordinates(df: DataFrame, cell: str, shape: list[int]) -> DataFrame:
    return df.select("*", *coordinates(F.col(cell), shape))


def lines(hits: DataFrame, cell: str, shape: list[int]) -> DataFrame:
    """Maximal runs along the last dimension: c0.., first, last. Islands within each line; a line is at most the last dimension long."""
    k, n = len(shape) - 1, shape[-1]
    # a line stays where it was dealt to, from its cells to its islands
    at = hits.select(F.col(cell).alias("_cell")).distinct().select(F.floor(F.col("_cell") / n).alias("_line"), (F.floor("_cell") % n).cast("long").alias("_at"))
    island = at.withColumn("_i", F.col("_at") - F.row_number().over(Window.partitionBy("_line").orderBy("_at")))
    run = island.groupBy("_line", "_i").agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    return run.select(*coordinates(F.col("_line"), shape[:-1]), "first", "last")


def components(hits: DataFrame, cell: str, shape: list[int]) -> DataFrame:
    """c0.., first, last, component: lines that touch in any dimension but the last share a component (its smallest cell)."""
    k = len(shape) - 1
    step = strides(shape)
    row = lines(hits, cell, shape)
    ident = reduce(lambda a, b: a + b, [F.col(f"c{i}") * step[i] for i in range(k)], F.lit(0).cast("long")) + F.col("first")
    row = checkpointed(row.withColumn("_id", ident.cast("long")))
    edges = None
    for i in range(k):
        other = row.select(*[(F.col(f"c{j}") + (1 if j == i else 0)).alias(f"d{j}") for j in range(k)], F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("_id").alias("v"))
        on = reduce(lambda a, b: a & b, [F.col(f"c{j}") == F.col(f"d{j}") for j in range(k)]) & (F.col("first") <= F.col("l2")) & (F.col("f2") <= F.col("last"))
        e = row.join(other, on).select(F.col("_id").alias("u"), "v")
        edges = e if edges is None else edges.unionByName(e)
    return labelled(row, edges).drop("_id")


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        from ..sources.store import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def labelled(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Rows with component: the smallest _id that edges (u, v) reach."""
    if edges is None:
        return rows.withColumn("component", F.col("_id"))
    return rows.join(connect(edges), "_id", "left").withColumn("component", F.coalesce("component", "_id"))


#: Edges that a task solves at once.
EDGES = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each reaches: roots hook to their lowest neighbour, then paths are cut short."""
    up = np.arange(n)
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(far := up[up], up):
            up = far
        u, v = up[u], up[v]
        open_ = u != v
        u, v = u[open_], v[open_]
    return up


def _solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges and the smallest node that they reach."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[_roots(at[: len(u)], at[len(u) :], len(ids))]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def solved() -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        ids, roots = _solve(u, v)
        for i in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000]), pa.array(roots[i : i + 50_000])], ["_id", "root"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= EDGES:
            yield from solved()
            held, n = [], 0
    if n:
        yield from solved()


def connect(edges: DataFrame) -> DataFrame:
    """(_id, component) of the nodes of edges (u, v): the smallest node that they reach.

    Edges near each other are solved together, EDGES at a time, and each lot leaves its nodes with a root. What is left are
    edges between roots of the nodes that several lots have; where ids of neighbours are close those are few. They are solved
    in one lot, else by the same step, or in rounds over all once the step no longer halves them.
    """
    spark = edges.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    edges = checkpointed(edges.select("u", "v"))  # else they are found twice: once for the ranges
    if edges.count() <= EDGES:
        return edges.coalesce(1).mapInArrow(_stars, "_id long, root long").withColumnRenamed("root", "component")
    near = edges.repartitionByRange(parts, "u").sortWithinPartitions("u")
    stars = checkpointed(near.mapInArrow(_stars, "_id long, root long"))
    low = stars.withColumn("low", F.min("root").over(Window.partitionBy("_id")))
    over = checkpointed(low.filter("root <> low").select(F.col("root").alias("u"), F.col("low").alias("v")).distinct())
    label, n = stars.groupBy("_id").agg(F.min("root").alias("root")), over.count()
    if not n:
        return label.withColumnRenamed("root", "component")
    if n <= EDGES // 2:
        top = over.coalesce(1).mapInArrow(_stars, "_id long, root long").select("_id", F.col("root").alias("component"))
    else:
        top = connect(over) if 2 * n <= stars.count() else _spread(over)
    top = top.withColumnRenamed("_id", "root")
    return label.join(top, "root", "left").select("_id", F.coalesce("component", "root").alias("component"))


def _spread(edges: DataFrame) -> DataFrame:
    """As ``connect``, for edges without any order: labels spread and jump; each round is checkpointed."""
    both = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpointed(both.select(F.col("u").alias("_id"), F.col("u").alias("component")).distinct())
    while True:
        near = both.join(label.withColumnRenamed("_id", "v"), "v").groupBy(F.col("u").alias("_id")).agg(F.min("component").alias("near"))
        new = label.join(near, "_id", "left").select("_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("_id").alias("component"), F.col("component").alias("far"))
        new = checkpointed(new.join(jump, "component").select("_id", "old", F.least("component", "far").alias("component")))
        label = new.select("_id", "component")
        if new.filter("old <> component").isEmpty():
            return label


def blocks(hits: DataFrame, cell: str, shape: list[int], merge: bool = True) -> DataFrame:
    """lo0, hi0, ..: disjoint boxes that cover the hits. Lines are merged dimension by dimension, the last first, where all else agrees."""
    k = len(shape) - 1
    if merge and (width := _slab_width(shape)):
        sides = _sides(k + 1)
        piece = checkpointed(_pieces(hits, cell, shape, width, False).select(*sides))
        end = _at_slab_end(width)
        none = hits.filter(F.col(cell).isNull()).select(*[F.lit(None).cast("long").alias(c) for c in sides]).distinct()
        return piece.filter(~end).unionByName(_runs(piece.filter(end), 0, k + 1)).unionByName(none)
    box = lines(hits, cell, shape).select(*[c for i in range(k) for c in (F.col(f"c{i}").alias(f"lo{i}"), F.col(f"c{i}").alias(f"hi{i}"))], F.col("first").alias(f"lo{k}"), F.col("last").alias(f"hi{k}"))
    for d in range(k - 1, -1, -1) if merge else ():
        box = _merged(box, d, k + 1)
    return box.select(*[f"{p}{i}" for i in range(k + 1) for p in ("lo", "hi")])


#: Coordinates that one task merges along a dimension at once.
SPAN = 4096


def _merged(box: DataFrame, d: int, dims: int) -> DataFrame:
    """Boxes of one coordinate in dimension d as runs: first within spans of SPAN, then those that meet the end of a span with each other."""
    lo, hi = F.col(f"lo{d}"), F.col(f"hi{d}")
    for span in (F.floor(lo / SPAN), F.when((lo % SPAN == 0) | ((hi + 1) % SPAN == 0), F.lit(-1)).otherwise(F.floor(lo / SPAN))):
        box = _runs(box.withColumn("_t", span.cast("long")), d, dims, "_t").drop("_t")
    return box


def _runs(box: DataFrame, d: int, dims: int, *keys: str) -> DataFrame:
    """Boxes that follow each other in dimension d and agree in all else, and in the keys, as one."""
    same = [c for c in _sides(dims) if c not in (f"lo{d}", f"hi{d}")] + [*keys]
    w = Window.partitionBy(*same).orderBy(f"lo{d}")
    start = F.coalesce((F.col(f"lo{d}") != F.lag(f"hi{d}").over(w) + 1).cast("int"), F.lit(1))
    grouped = box.withColumn("_s", start).withColumn("_g", F.sum("_s").over(w))
    return grouped.groupBy(*same, "_g").agg(F.min(f"lo{d}").alias(f"lo{d}"), F.max(f"hi{d}").alias(f"hi{d}")).drop("_g")


def _sides(dims: int) -> list[str]:
    return [f"{p}{i}" for i in range(dims) for p in ("lo", "hi")]


#: Cells of a slab, a stretch of whole planes of the first dimension that a task works on at once; it has PLANES of them at least.
SLAB, PLANES = 1 << 18, 64


def _slab_width(shape: list[int]) -> int:
    """Planes of a slab; 0 if they are too large for slabs."""
    width = SLAB // max(1, strides(shape)[0])
    return width if len(shape) > 1 and width >= PLANES else 0


def _at_slab_end(width: int) -> Column:
    return (F.pmod("lo0", F.lit(width)) == 0) | (F.pmod(F.col("hi0") + 1, F.lit(width)) == 0)


def _pieces(hits: DataFrame, cell: str, shape: list[int], width: int, connected: bool) -> DataFrame:
    """The boxes of each slab: lo0, hi0, .., and if connected, their component within it: its smallest cell _root, whether it meets
    an end of the slab (_open), and the smallest hash of its boxes. One exchange by slab; a task holds one slab at a time."""
    floor = lambda x, n: f"({x} - pmod({x}, {n}L)) div {n}L"  # noqa: E731  # exact beyond 2^53
    at = hits.select(F.col(cell).cast("long").alias("_cell")).filter("_cell is not null")
    at = at.selectExpr(f"{floor('_cell', strides(shape)[0])} % {shape[0]}L as _c", "_cell").selectExpr(f"{floor('_c', width)} as _t", "_cell")
    at = at.repartition(4 * hits.sparkSession.sparkContext.defaultParallelism, "_t").sortWithinPartitions("_t")
    names = [*_sides(len(shape)), *(["_root", "_open", "component"] if connected else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slab = [], None

        def out() -> Iterator[pa.RecordBatch]:
            cols = _slab(np.unique(np.concatenate(held)), int(slab), shape, width, connected)
            for i in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cols], names)

        for b in batches:
            if not b.num_rows:
                continue
            t, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
            for s, part in zip(t[np.r_[0, cuts]], np.split(c, cuts)):
                if held and s != slab:
                    yield from out()
                    held = []
                slab = s
                held.append(part)
        if held:
            yield from out()

    return at.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == '_open' else 'long'}" for c in names))


def _slab(cells: np.ndarray, slab: int, shape: list[int], width: int, connected: bool) -> list[np.ndarray]:
    """The columns of ``_pieces`` for the sorted cells of a slab."""
    dims, step = len(shape), strides(shape)
    at = [np.fmod(cells // s, n) for s, n in zip(step, shape)]
    line = cells // shape[-1]
    new = np.r_[True, (cells[1:] != cells[:-1] + 1) | (line[1:] != line[:-1])]
    of, start = np.cumsum(new) - 1, np.flatnonzero(new)  # of: the box of each cell
    lo, hi = [a[start] for a in at], [a[np.r_[start[1:], len(cells)] - 1] for a in at]
    for d in range(dims - 2, -1, -1):
        order = np.lexsort((lo[d], *[x[i] for i in range(dims) if i != d for x in (lo, hi)]))
        lo, hi = [x[order] for x in lo], [x[order] for x in hi]
        new = np.r_[True, lo[d][1:] != hi[d][:-1] + 1]
        for x in [x[i] for i in range(dims) if i != d for x in (lo, hi)]:
            new[1:] |= x[1:] != x[:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        of, start = place[of], np.flatnonzero(new)
        lo, hi = [x[start] for x in lo], [x[np.r_[start[1:], len(order)] - 1] for x in hi]
    sides = [x[i] for i in range(dims) for x in (lo, hi)]
    if not connected:
        return sides
    us, vs = [], []
    for d in range(dims - 1):  # cells beside each other in the last dimension share a box
        mine = np.flatnonzero(at[d] + 1 < shape[d])
        other = np.searchsorted(cells, cells[mine] + step[d])
        found = cells[np.minimum(other, len(cells) - 1)] == cells[mine] + step[d]
        us.append(of[mine[found]])
        vs.append(of[other[found]])
    u, v = np.concatenate(us), np.concatenate(vs)
    root = _roots(u[u != v], v[u != v], len(lo[0]))
    first, open_, name = np.empty(len(root), np.int64), np.zeros(len(root), bool), np.full(len(root), np.iinfo(np.int64).max)
    first[root[of[::-1]]] = cells[::-1]
    open_[root[(lo[0] % width == 0) | ((hi[0] + 1) % width == 0)]] = True
    np.minimum.at(name, root, _xxhash64(sides))
    return [*sides, first[root], open_[root], name[root]]


def _xxhash64(columns: list[np.ndarray]) -> np.ndarray:
    """Spark's xxhash64 of long columns."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = (h + p5 + np.uint64(8)) ^ (turn(c.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def connected_blocks(hits: DataFrame, cell: str, shape: list[int]) -> DataFrame:
    """``block_components`` of ``blocks``. Slabs solve their own components; only those that meet an end of a slab are looked at together."""
    dims, width = len(shape), _slab_width(shape)
    if not width:
        return block_components(blocks(hits, cell, shape), dims)
    piece = checkpointed(_pieces(hits, cell, shape, width, True))
    some = piece.filter("_open").drop("_open", "component")
    face = some.withColumnRenamed("_root", "_id")
    edges = _touching(face.filter(F.pmod(F.col("hi0") + 1, F.lit(width)) == 0), face.filter(F.pmod("lo0", F.lit(width)) == 0), 0, dims)
    some = checkpointed(labelled(face, edges.distinct()).drop("_id").withColumnRenamed("component", "_root"))
    end = _at_slab_end(width)
    some = some.filter(~end).unionByName(_runs(some.filter(end), 0, dims, "_root")).withColumn("_hash", F.xxhash64(*_sides(dims)))
    some = some.join(some.groupBy("_root").agg(F.min("_hash").alias("component")), "_root")
    return piece.filter("not _open").drop("_root", "_open").unionByName(some.drop("_root", "_hash"))


def _touching(up: DataFrame, down: DataFrame, d: int, dims: int) -> DataFrame:
    """Pairs (u, v) of boxes with an _id: v begins in dimension d where u ends. They meet in the coarse cells of their common faces."""
    rest = [i for i in range(dims) if i != d]
    wide = max(1, 8 // max(1, len(rest)))
    at = [f"_f{i}" for i in rest]
    for i in rest:
        cells = F.explode(F.sequence(F.floor(F.col(f"lo{i}") / wide), F.floor(F.col(f"hi{i}") / wide)))
        up, down = up.withColumn(f"_f{i}", cells), down.withColumn(f"_f{i}", cells)
    up = up.select(F.col("_id").alias("u"), (F.col(f"hi{d}") + 1).alias("_at"), *at, *[F.col(f"{p}{i}").alias(f"u{p}{i}") for i in rest for p in ("lo", "hi")])
    down = down.select(F.col("_id").alias("v"), F.col(f"lo{d}").alias("_at"), *at, *[f"{p}{i}" for i in rest for p in ("lo", "hi")])
    e = up.join(down, ["_at", *at])
    for i in rest:
        e = e.filter((F.col(f"ulo{i}") <= F.col(f"hi{i}")) & (F.col(f"lo{i}") <= F.col(f"uhi{i}")))
    return e.select("u", "v")


def block_components(box: DataFrame, dims: int) -> DataFrame:
    """Boxes and their component, named by the smallest hash of a box. Neighbours meet in the coarse cells of their common faces, so this is an equi join."""
    box = checkpointed(box.withColumn("_hash", F.xxhash64(*box.columns)))
    ends = box.agg(*[f(f"{p}{i}") for i in range(dims) for p, f in (("lo", F.min), ("hi", F.max))]).first()
    low, size = [ends[2 * i] or 0 for i in range(dims)], [(ends[2 * i + 1] or 0) - (ends[2 * i] or 0) + 1 for i in range(dims)]
    ident = F.col("_hash")
    if reduce(lambda a, b: a * b, size, 1) < 2**63:  # the number of a box's first cell: neighbours have close ones
        ident = reduce(lambda a, b: a + b, [(F.col(f"lo{i}") - low[i]) * F.lit(n).cast("long") for i, n in enumerate(strides(size))])
    face = box.select(ident.alias("_id"), *[f"{p}{i}" for i in range(dims) for p in ("lo", "hi")])
    edges = None
    for d in range(dims):
        e = _touching(face, face, d, dims)
        edges = e if edges is None else edges.unionByName(e)
    out = labelled(box.withColumn("_id", ident), edges).withColumnRenamed("component", "_root")
    names = out.groupBy("_root").agg(F.min("_hash").alias("component"))
    return out.join(names, "_root").drop("_root", "_id", "_hash")


def hyperslab(df: DataFrame, cell: str, shape: list[int], slab: list[tuple[int, int, int]]) -> DataFrame:
    """Rows whose coordinates are in (begin, end, stride) of each dimension; the end is not included."""
    out = df
    for c, (begin, end, step) in zip(coordinates(F.col(cell), shape), slab):
        out = out.filter((c >= begin) & (c < end) & ((c - begin) % step == 0))
    return out
