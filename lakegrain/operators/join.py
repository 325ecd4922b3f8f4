"""Equi and band joins of relations."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import parse as P
from ..plans.lower import Scope, fold
from ..plans.select import mask


def qualified(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns])


def joined_scope(df: DataFrame, sides: list[tuple[str, list[str]]], local_zone: str = "UTC") -> Scope:
    return Scope(df, {a: [(c, f"{a}.{c}") for c in cols] for a, cols in sides}, local_zone)


def _owner(node: Any, left: Scope, right: Scope) -> str | None:
    """Which side all columns of a term come from; unqualified names try the left side first."""
    sides = {"l" if left.find(n) is not None else "r" if right.find(n) is not None else "?" for n in P.references(node)}
    if "?" in sides:
        raise P.ParseError(f"unknown column among {sorted(P.references(node))}")
    return sides.pop() if len(sides) == 1 else None


def _linear(node: Any) -> tuple[Any, float] | None:
    """A term as (column term, constant added)."""
    node = fold(node)
    if isinstance(node, P.Bin) and node.op in "+-":
        if isinstance(node.right, P.Num):
            inner = _linear(node.left)
            return inner and (inner[0], inner[1] + (float(node.right.value) if node.op == "+" else -float(node.right.value)))
        if isinstance(node.left, P.Num) and node.op == "+":
            inner = _linear(node.right)
            return inner and (inner[0], inner[1] + float(node.left.value))
        return None
    return (node, 0.0) if P.references(node) else None


def _bound(c: P.Cmp, owner) -> tuple[Any, Any, str, float] | None:
    """A comparison as (left term, right term, op, d): left - right op d."""
    if c.op == "!=":
        return None
    a, b, op = fold(c.left), fold(c.right), c.op
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
    for x, y, o in ((a, b, op), (b, a, flip[op])):
        if isinstance(y, P.Num) and isinstance(x, P.Bin) and x.op == "-":
            p, q = _linear(x.left), _linear(x.right)
            if p and q:
                if (owner(p[0]), owner(q[0])) == ("l", "r"):
                    return p[0], q[0], o, float(y.value) - p[1] + q[1]
                if (owner(p[0]), owner(q[0])) == ("r", "l"):
                    return q[0], p[0], flip[o], -(float(y.value) - p[1] + q[1])
    p, q = _linear(a), _linear(b)
    if p and q:
        if (owner(p[0]), owner(q[0])) == ("l", "r"):
            return p[0], q[0], op, q[1] - p[1]
        if (owner(p[0]), owner(q[0])) == ("r", "l"):
            return q[0], p[0], flip[op], p[1] - q[1]
    return None


def _constant(c: P.Cmp) -> float:
    """The largest constant that a band adds or compares with: its size bounds what rounding may move."""

    def walk(node: Any) -> float:
        if isinstance(node, P.Bin) and node.op in "+-":
            return max(walk(node.left), walk(node.right))
        return abs(float(node.value)) if isinstance(node, P.Num) else 0.0

    return max(walk(fold(c.left)), walk(fold(c.right)))


def _nan_fits(conditions: list[P.Cmp], owner, side: str) -> bool:
    """Whether a NaN on one side fits every row of the other: NaN is the greatest number, also as a sum or difference."""

    def fits(c: P.Cmp) -> bool:
        a, b = (any(owner(P.Col(n)) == side for n in P.references(x)) for x in (c.left, c.right))
        return c.op in ((">=", "<=", "=") if a and b else (">", ">=") if a else ("<", "<="))

    return all(map(fits, conditions))


#: Cells to a band's width, and rows of a cell from each side that meet in one piece of the join.
CELLS, PIECE = 4, 4096
#: Candidate pairs that a task compares, about, and tasks of a join at most: beyond those, tasks grow.
TASK_PAIRS, MOST_TASKS = 2.0**25, 10_000
#: Values up to so many cells from 0 have numbered cells; with constants up to FAR / 64 cells, rounding moves them by less than MARGIN of a cell.
FAR, MARGIN = 2.0**40, 1 / 16


def band_join(
    left: DataFrame, right: DataFrame, lcol, rcol, low: float, high: float, low_op: str = ">=", high_op: str = "<=", condition=None, scale: float = 0.0, nan_left: bool = False, nan_right: bool = False
) -> DataFrame:
    """Rows with low <= l - r <= high, or those of them for which ``condition`` holds as it is written, up to its rounding.

    Cells only find candidates: CELLS of them make the band's width, l is in one of them and r in all that its band meets.
    A cell of more than PIECE rows of a side is cut into a grid of pieces, so no task grows with a frequent value; all is
    streamed from sorted runs, and rows with null keys have no partner. The candidates are counted first, and tasks are as many
    as they need. ``scale`` is the largest constant in ``condition``;
    ``nan_left`` and ``nan_right`` tell that a NaN of that side fits all rows of the other.
    """
    width, scale = high - low, max(scale, abs(low), abs(high))
    if condition is None:
        diff = F.col("_l") - F.col("_r")
        condition = (diff >= low if low_op == ">=" else diff > low) & (diff <= high if high_op == "<=" else diff < high)
    if width < -scale * 2.0**-40:
        return left.crossJoin(right).filter(F.lit(False))
    a = left.withColumn("_l", lcol).filter(F.col("_l").isNotNull())
    b = right.withColumn("_r", rcol).filter(F.col("_r").isNotNull())
    step = max(width / CELLS, scale * 64 / FAR, 1e-300)
    if not step < 1e280:
        return a.join(b, condition).drop("_l", "_r")
    if scale == 0:
        out = a.join(b, (F.col("_l") == F.col("_r")) & condition)
    else:
        out = _cell_join(a, b, low, high, step, condition)
    isnan = lambda c: F.isnan(F.col(c).cast("double"))
    if nan_right:
        out = out.union(a.filter(~isnan("_l")).join(F.broadcast(b.filter(isnan("_r"))), condition))
    if nan_left:
        out = out.union(F.broadcast(a.filter(isnan("_l"))).join(b.filter(~isnan("_r")), condition))
    return out.drop("_l", "_r")


def _cell_join(a: DataFrame, b: DataFrame, low: float, high: float, step: float, condition) -> DataFrame:
    far = lambda x: F.xxhash64(x.cast("float"))  # noqa: E731  # cells of values far from 0: a float's precision
    l, x0, x1, limit = F.col("_l"), F.col("_r") + F.lit(low), F.col("_r") + F.lit(high), F.lit(step * FAR)
    a = a.withColumn("_cell", F.when(F.abs(l) <= limit, F.floor(l / F.lit(step))).otherwise(far(l)))
    none = F.array().cast("array<bigint>")
    numbered = F.when(F.abs(x0) <= limit * 2, F.sequence(F.floor(x0 / F.lit(step) - MARGIN), F.floor(x1 / F.lit(step) + MARGIN))).otherwise(none)
    others = F.when(F.abs(x0) <= limit / 2, none).otherwise(F.array(far(x0 * (1 - 2.0**-30)), far(x0 * (1 + 2.0**-30))))
    b = b.withColumn("_cell", F.explode(F.array_distinct(F.concat(numbered, others))))
    n = a.select("_cell", F.lit(1).alias("_n"), F.lit(0).alias("_m")).unionByName(b.select("_cell", F.lit(0).alias("_n"), F.lit(1).alias("_m")))
    n = n.groupBy("_cell").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).filter("_n > 0 and _m > 0")
    # frequent cells, each in a row, and the others in one without a number; so few that they can be sent to all: one for PIECE rows at most
    n = n.groupBy(F.when(F.greatest("_n", "_m") > PIECE, F.col("_cell")).alias("_cell")).agg(F.max("_n").alias("_n"), F.max("_m").alias("_m"), F.sum(F.col("_n").cast("double") * F.col("_m")).alias("_pairs"))
    spark, n = a.sparkSession, n.toArrow()
    pairs = sum(n["_pairs"].to_pylist())
    grid = spark.createDataFrame(n.drop_columns("_pairs")).filter("_cell is not null")
    grid = F.broadcast(grid.select("_cell", F.ceil(F.col("_n") / PIECE).alias("_n"), F.ceil(F.col("_m") / PIECE).alias("_m")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, min(MOST_TASKS, int(pairs / TASK_PAIRS)))

    def pieces(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(grid, "_cell", "left").fillna(1, ["_n", "_m"])
        mine, all_others = F.floor(F.rand(7) * F.col(own)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        df = df.withColumn("_own", mine).withColumn("_other", all_others)
        piece = F.col("_own") * F.col("_m") + F.col("_other") if own == "_n" else F.col("_other") * F.col("_m") + F.col("_own")
        # a number of partitions given is kept, however few bytes they have
        return df.withColumn("_piece", piece).drop("_n", "_m", "_own", "_other").repartition(parts, "_cell", "_piece")

    a, b = pieces(a, "_n", "_m"), pieces(b, "_m", "_n").withColumnRenamed("_cell", "_cell2").withColumnRenamed("_piece", "_piece2")
    on = (F.col("_cell") == F.col("_cell2")) & (F.col("_piece") == F.col("_piece2")) & condition
    return a.join(b.hint("merge"), on).drop("_cell", "_piece", "_cell2", "_piece2")


def join(sources: list[tuple[str, DataFrame]], condition: Any, using: list[str] = (), refs: set[str] = frozenset(), local_zone: str = "UTC") -> tuple[DataFrame, Scope]:
    """Inner join of the relations, one after the other; conditions on one side are applied before the join.

    Join conditions may be equalities, bands with constant ends, or any comparison beside one of
    those. Two relations without a join condition are refused.
    """
    (alias, df), *rest = sources
    sides = [(alias, df.columns)]
    left, parts = qualified(df, alias), P.conjuncts(condition)
    if len({a.lower() for a, _ in sources}) < len(sources):
        raise P.ParseError("give each table of a join its own alias")
    for alias, df in rest:
        right = qualified(df, alias)
        ls, rs = joined_scope(left, sides, local_zone), joined_scope(right, [(alias, df.columns)], local_zone)
        both = joined_scope_types(left, right, sides + [(alias, df.columns)], local_zone)
        owner = lambda node: _owner(node, ls, rs)
        mine, join_parts, later = {"l": [], "r": []}, [], []
        for c in parts:
            try:
                side = owner(c) if P.references(c) else None
            except P.ParseError:
                later.append(c)
                continue
            if side:
                mine[side].append(c)
            elif P.references(c):
                join_parts.append(c)
            else:
                later.append(c)
        left, right = _side(left, ls, mine["l"], refs), _side(right, rs, mine["r"], refs)
        equal = [(ls.column(u), rs.column(u)) for u in using]
        bands: dict[tuple, dict] = {}
        rest_parts = []
        for c in join_parts:
            got = _bound(c, owner) if isinstance(c, P.Cmp) else None
            if isinstance(c, P.Cmp) and c.op == "=" and {owner(c.left), owner(c.right)} == {"l", "r"}:
                a, b = (c.left, c.right) if owner(c.left) == "l" else (c.right, c.left)
                equal.append((ls.value(a), rs.value(b)))
            elif got:
                band = bands.setdefault((got[0], got[1]), {"c": []})
                for op in (">=", "<=") if got[2] == "=" else (got[2],):
                    side, sign = op[0], 1 if op[0] == ">" else -1
                    new, old = (sign * got[3], len(op) == 1), band.get(side)  # of bounds at one value the strict one is closer
                    if old is None or new > (sign * old[0], len(old[1]) == 1):
                        band[side] = (got[3], op)
                band["c"].append(c)
            else:
                rest_parts.append(c)
        closed = next((k for k, v in bands.items() if "<" in v and ">" in v), None)
        if equal:
            on = reduce(lambda x, y: x & y, [a == b for a, b in equal])
            extra = [both.condition(c) for c in rest_parts + [c for v in bands.values() for c in v["c"]]]
            left = left.join(right, reduce(lambda x, y: x & y, extra, on))
        elif closed:
            v = bands.pop(closed)
            exact = {}
            if not any(both.is_text(x) for c in v["c"] for x in (c.left, c.right)):  # numbers kept as text compare by their difference
                exact = {"condition": reduce(lambda x, y: x & y, map(both.condition, v["c"])), "scale": max(map(_constant, v["c"]))}
                exact |= {"nan_left": _nan_fits(v["c"], owner, "l"), "nan_right": _nan_fits(v["c"], owner, "r")}
            left = band_join(left, right, ls.number(closed[0]), rs.number(closed[1]), v[">"][0], v["<"][0], v[">"][1], v["<"][1], **exact)
            later += rest_parts + [c for w in bands.values() for c in w["c"]]
        elif join_parts:
            left = left.join(right, reduce(lambda x, y: x & y, [both.condition(c) for c in join_parts]))
        else:
            raise P.ParseError("two tables need a join condition")
        sides.append((alias, df.columns))
        parts = later
    scope = joined_scope(left, sides, local_zone)
    for c in parts:
        left = left.filter(scope.condition(c))
    return left, scope


def joined_scope_types(left: DataFrame, right: DataFrame, sides, local_zone: str) -> Scope:
    """Scope over the columns of both sides before they are one relation."""
    scope = joined_scope(left, sides, local_zone)
    scope.types |= {f.name.lower(): f for f in right.schema.fields}
    return scope


def _side(df: DataFrame, scope: Scope, parts: list[Any], refs: set[str]) -> DataFrame:
    names = set().union(*map(P.references, parts), {r for r in refs if scope.find(r) is not None})
    if (m := mask(scope, names)) is not None:
        df = df.filter(m)
    for c in parts:
        df = df.filter(scope.condition(c))
    return df


def estimate(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Bounds on the rows of a join without doing it."""
    return 0, left.count() * right.count()
