"""Histograms of one to three dimensions: counts or weights, regular or adaptive, bins as row sets, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (column, begin, end, stride) of a dimension.
Axis = tuple[str, float, float, float]


def n_bins(begin: float, end: float, stride: float) -> int:
    if stride == 0 or (end - begin) / stride < 0:
        raise ValueError("the stride does not lead from begin to end")
    return 1 + int((end - begin) // stride)


def bin_of(axis: Axis) -> Column:
    """Bin number; null outside [begin, end]."""
    c, begin, end, stride = axis
    x = F.col(c).cast("double")
    return F.when((x >= min(begin, end)) & (x <= max(begin, end)), F.floor((x - begin) / stride).cast("int"))


def histogram(df: DataFrame, axes: list[Axis], weight: str | None = None) -> DataFrame:
    """bin (row-major over the axes), bin0.. and value (count, or sum of weights) of every bin, empty ones too.

    Bins are [b, b + stride), the last is closed at the end; rows with a null in any column used do not count.
    """
    names = [f"bin{i}" for i in range(len(axes))]
    cols = [a[0] for a in axes] + ([weight] if weight else [])
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    cells = rows.select(*[bin_of(a).alias(n) for a, n in zip(axes, names)], *([F.col(weight).cast("double").alias("_w")] if weight else []))
    cells = cells.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    value = F.sum("_w") if weight else F.count(F.lit(1))
    found = cells.groupBy(*names).agg(value.alias("value"))
    sizes = [n_bins(*a[1:]) for a in axes]
    total, number, rest = reduce(lambda a, b: a * b, sizes), [], F.col("bin")
    for i in range(len(sizes)):
        after = reduce(lambda a, b: a * b, sizes[i + 1 :], 1)
        number.append(F.floor(rest / after).cast("int").alias(names[i]))
        rest = rest % after
    every = df.sparkSession.range(total).select(F.col("id").alias("bin")).select("bin", *number)
    zero = F.lit(0.0) if weight else F.lit(0).cast("long")
    return every.join(found, names, "left").select("bin", *names, F.coalesce("value", zero).alias("value"))


def bins(df: DataFrame, axes: list[Axis], row_id: str, weight: str | None = None) -> DataFrame:
    """(bin0.., row_id[, weight]): the rows of each bin, one row each; nothing is gathered."""
    names = [f"bin{i}" for i in range(len(axes))]
    out = df.select(*[bin_of(a).alias(n) for a, n in zip(axes, names)], F.col(row_id).alias("row_id"), *([F.col(weight).alias("weight")] if weight else []))
    return out.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))


def cut_points(df: DataFrame, col: str, n: int, weight: str | None = None) -> list[float]:
    """Lower ends of at most n bins of about equal weight. Values are first summed, so few values give one bin each."""
    x = F.col(col).cast("double")
    values = df.filter(F.col(col).isNotNull()).groupBy(x.alias("v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("w"))
    few = [r["v"] for r in values.orderBy("v").limit(n + 1).select("v").collect()]
    if len(few) <= n:
        return few
    qs = [i / n for i in range(n)]
    if weight:
        cuts = values.agg(F.percentile("v", F.array(*map(F.lit, qs)), F.greatest(F.round(F.col("w")).cast("long"), F.lit(0).cast("long")))).first()[0]
    else:
        cuts = df.filter(F.col(col).isNotNull()).approxQuantile(col, qs, 0.001)
    return sorted(set(cuts))


def place(col: str, cuts: list[float]) -> Column:
    """Number of the last cut point at or below the value (below the first: 0)."""
    x = F.col(col).cast("double")
    inner = F.array(*[F.lit(float(c)) for c in cuts[1:]]) if len(cuts) > 1 else F.array().cast("array<double>")
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda c: c <= x)))


def adaptive(df: DataFrame, cols: list[str], n: list[int], weight: str | None = None) -> DataFrame:
    """bin0.., low0.., value: bins of about equal weight in each dimension; empty bins are left out."""
    cuts = [cut_points(df, c, k, weight) for c, k in zip(cols, n)]
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols + ([weight] if weight else [])]))
    names = [f"bin{i}" for i in range(len(cols))]
    w = [F.col(weight).cast("double").alias("_w")] if weight else []
    found = rows.select(*[place(c, k).alias(b) for c, k, b in zip(cols, cuts, names)], *w).groupBy(*names).agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("value"))
    low = [F.element_at(F.array(*[F.lit(float(x)) for x in k]), F.col(b) + 1).alias(f"low{i}") if k else F.lit(None).cast("double").alias(f"low{i}") for i, (k, b) in enumerate(zip(cuts, names))]
    return found.select(*names, *low, "value")


def distribution(df: DataFrame, col: str, bounds: list[float], weight: str | None = None) -> DataFrame:
    """bin, low, high, value: below the first bound, between bounds, and from the last on."""
    n = len(bounds) + 1
    rows = df.filter(F.col(col).isNotNull()).select(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda c: c <= F.col(col).cast("double"))).alias("bin"), *([F.col(weight).alias("_w")] if weight else []))
    found = rows.groupBy("bin").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("value"))
    ends = [None, *map(float, bounds), None]
    every = df.sparkSession.createDataFrame([(i, ends[i], ends[i + 1]) for i in range(n)], "bin int, low double, high double")
    return every.join(found, "bin", "left").fillna(0, ["value"])


def cumulative(df: DataFrame, axis: Axis, weight: str | None = None) -> DataFrame:
    """bin, value, total: the histogram and its running sum. One row for each bin goes through the window."""
    return histogram(df, [axis], weight).select("bin", "value").withColumn("_g", F.lit(0)).withColumn("total", F.sum("value").over(Window.partitionBy("_g").orderBy("bin"))).drop("_g")


def joint(df: DataFrame, one: str, two: str, bounds1: list[float], bounds2: list[float]) -> DataFrame:
    """bin0, bin1, value over open-ended bins of two columns; empty cells are left out."""
    def at(c, bounds):
        return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda x: x <= F.col(c).cast("double")))

    rows = df.filter(F.col(one).isNotNull() & F.col(two).isNotNull())
    return rows.select(at(one, bounds1).alias("bin0"), at(two, bounds2).alias("bin1")).groupBy("bin0", "bin1").agg(F.count(F.lit(1)).alias("value"))


def equal_weight_map(df: DataFrame, col: str, n: int) -> DataFrame:
    """All columns, and ``bin``: which of n bins of about equal weight the row is in."""
    return df.withColumn("bin", place(col, cut_points(df, col, n)))
