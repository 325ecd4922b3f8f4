"""Components of graphs and meshes: edges are solved in lots, whatever their order."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lakegrain.operators import mesh


def smallest(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("lot, kind", [(1_000_000, "chain"), (64, "chain"), (64, "random"), (8, "star"), (8, "random")])
def test_edges_in_lots(spark, monkeypatch, lot, kind):
    monkeypatch.setattr(mesh, "EDGES", lot)
    rng = random.Random(lot)
    edges = {
        "chain": [(i, i + 1) for i in range(3000) if i % 997], "random": [(rng.randrange(10**12), i) for i in range(50)] + [(rng.randrange(400), rng.randrange(900)) for _ in range(500)],
        "star": [(i, 500) for i in range(300)] + [(i, i) for i in range(600, 640)],
    }[kind]
    rng.shuffle(edges)
    got = [tuple(r) for r in mesh.connect(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == smallest(edges)


def test_a_long_chain_takes_few_jobs(spark):
    """Rounds over all lines grew with the length of a chain; lots of close edges leave one small graph."""
    sc = spark.sparkContext
    hits = spark.range(0, 40000, 2).select(F.col("id").alias("cell"))
    sc.setJobGroup("chain", "chain")
    try:
        out = mesh.components(hits, "cell", [20000, 2]).select("component").distinct().collect()
    finally:
        jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in out] == [(0,)] and jobs < 40


def test_runs_across_spans(spark, monkeypatch):
    monkeypatch.setattr(mesh, "SPAN", 4)
    rng = random.Random(1)
    rows = [i for i in range(200) if rng.random() < 0.8]
    hits = spark.createDataFrame([(i * 10 + c,) for i in rows for c in (2, 3)], "cell long")
    want, runs = set(rows), []
    for i in rows:
        if i - 1 not in want:
            j = i
            while j + 1 in want:
                j += 1
            runs.append((i, j, 2, 3))
    box = mesh.blocks(hits, "cell", [200, 10])
    assert sorted(map(tuple, box.collect())) == runs
    assert len({r.component for r in mesh.block_components(box, 2).collect()}) == len(runs)


def test_block_components_of_three_dimensions(spark):
    rng = random.Random(3)
    shape = [12, 9, 10]
    hits = {(a, b, c) for a in range(12) for b in range(9) for c in range(10) if rng.random() < 0.33}
    edges = [(p, p) for p in hits]
    for p in hits:
        for d in range(3):
            q = tuple(x + (i == d) for i, x in enumerate(p))
            edges += [(p, q)] if q in hits else []
    label = smallest(edges)
    cells = spark.createDataFrame([((a * 9 + b) * 10 + c,) for a, b, c in hits], "cell long")
    of = {}
    for r in mesh.block_components(mesh.blocks(cells, "cell", shape), 3).collect():
        for a in range(r.lo0, r.hi0 + 1):
            for b in range(r.lo1, r.hi1 + 1):
                for c in range(r.lo2, r.hi2 + 1):
                    of[a, b, c] = r.component
    assert set(of) == hits
    pairs = {(label[p], of[p]) for p in hits}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 5


@pytest.mark.parametrize("slab", [240, 64, 32])
def test_blocks_in_slabs_are_those_of_the_whole_mesh(spark, monkeypatch, slab):
    """Boxes, components and their names do not depend on slabs; one box and one component run through all of them."""
    rng = random.Random(slab)
    shape = [100, 3, 4] if slab > 64 else [300, 8]
    last = shape[-1]
    cells = [c for c in range(math.prod(shape)) if rng.random() < 0.4 or c % last == 2 and c // last % 3 == 1 or c % last == 0 and len(shape) == 2]
    hits = spark.createDataFrame([(c,) for c in cells + cells[:50] + [None]], "cell long").repartition(3)
    monkeypatch.setattr(mesh, "SLAB", 0)
    assert not mesh._slab_width(shape)
    boxes = mesh.blocks(hits, "cell", shape)
    want, named = sorted(map(str, boxes.collect())), sorted(map(tuple, mesh.block_components(boxes, len(shape)).collect()))
    monkeypatch.setattr(mesh, "SLAB", slab)
    monkeypatch.setattr(mesh, "PLANES", 1)
    assert 3 < shape[0] / mesh._slab_width(shape)
    assert sorted(map(str, mesh.blocks(hits, "cell", shape).collect())) == want
    got = mesh.connected_blocks(hits, "cell", shape)
    assert sorted(map(tuple, got.collect())) == named and len({r[-1] for r in named}) > 3
    assert got.columns == mesh.block_components(boxes, len(shape)).columns


def test_block_components_take_few_stages(spark):
    """All boxes went through an exchange for each merge, face, label and name; now cells go through one by slab."""
    sc = spark.sparkContext
    sc.setJobGroup("slabs", "slabs")
    try:
        rows = __spark_entry__.queries()["g_block_components"](spark, "/root/testdata/sf0.001").count()
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("slabs") for s in sc.statusTracker().getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert rows and len(stages) < 45
