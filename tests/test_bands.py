"""Band joins against the nested loop over their conditions as written."""

import random

import pytest
from pyspark.sql import functions as F

from lakegrain.operators import join as J
from lakegrain.session import Engine

NAN, INF = float("nan"), float("inf")


def engine(spark, xs, ys):
    e = Engine(spark)
    e.register("l", spark.createDataFrame(list(enumerate(xs)), "i int, x double"))
    e.register("r", spark.createDataFrame(list(enumerate(ys)), "j int, y double"))
    return e


def pairs(e, condition):
    """Pairs of the engine and of the nested loop, sorted. Constants end in D for Spark, to be doubles."""
    got = e.sql(f"select l.i as i, r.j as j from l join r on {condition.replace('D', '')}")
    want = e.table("l").alias("l").crossJoin(e.table("r").alias("r")).filter(F.expr(condition)).select("i", "j")
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(
    "condition",
    [
        "-10.5D < l.x - r.y and l.x < r.y + 10.5D", "l.x > r.y - 0.3D and l.x - r.y <= 0.1D", "l.x - r.y between 0.1D and 0.1D", "l.x - r.y = 0.3D", "l.x between r.y - 20D and r.y + 30D",
        "l.x - r.y >= 0D and l.x <= r.y", "l.x + 1e17D - r.y between 1e17D and 1e17D", "r.y - l.x < 2D and l.x >= r.y + 1D", "r.y - l.x > -2D and l.x > r.y - 1D",
    ],
)
def test_bands_round_as_written(spark, condition):
    rng = random.Random(5)
    xs = [round(rng.uniform(-50, 50), 2) for _ in range(300)] + [0.1, 0.2, 0.3, 1e16, 1e16 + 2, 2.0**53, 1e300, -1e300, 5e-324, INF, -INF, NAN, None, -0.0]
    ys = [round(x - d, 2) for x, d in zip(xs, [0.1, 0.3, 10.5, -10.5, 20, -30] * 50)] + xs[300:]
    e = engine(spark, xs, ys)
    got, want = pairs(e, condition)
    assert got == want and want


def test_few_cells_are_joined_in_many_tasks(spark, monkeypatch):
    """Frequent values, and a band wider than one side: pieces of both sides meet once, in tasks that share the work."""
    monkeypatch.setattr(J, "PIECE", 16)
    rng = random.Random(6)
    xs = [round(rng.uniform(0, 3), 1) for _ in range(400)] + [7.0] * 200
    ys = [7.5] * 150 + [rng.uniform(-40, 40) for _ in range(300)]
    e = engine(spark, xs, ys)
    got, want = pairs(e, "l.x between r.y - 20D and r.y + 30D")
    assert got == want and len(want) > 50000
    out = e.sql("select l.i as i, r.j as j from l join r on l.x between r.y - 20 and r.y + 30")
    of = [n for _, n in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(of) >= 8 and max(of) < 0.3 * len(want)


def test_tasks_grow_with_the_candidates(spark, monkeypatch):
    """A number of tasks that was fixed made the longest task grow with the pairs, the square of the tables."""
    monkeypatch.setattr(J, "PIECE", 16)
    monkeypatch.setattr(J, "TASK_PAIRS", 1000)
    tasks = []
    for n in (300, 600):
        e = engine(spark, [i % 10 / 2 for i in range(n)], [i % 7 / 1 for i in range(n)])
        got, want = pairs(e, "l.x between r.y - 2D and r.y + 3D")
        assert got == want and want
        tasks.append(e.sql("select l.i as i, r.j as j from l join r on l.x between r.y - 2 and r.y + 3").rdd.getNumPartitions())
    assert tasks[1] > 3 * tasks[0] > 3 * 16
