"""Select lists with implicit group-by, conditions with the null mask, order and limit."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parse as P
from .lower import Scope


def mask(scope: Scope, names: set[str]) -> Column | None:
    """Non-null in every column that is mentioned."""
    cols = {f.name for n in names if (f := scope.find(n)) is not None}
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in sorted(cols)]) if cols else None


def restrict(df: DataFrame, condition: Any, extra: set[str] = frozenset(), scope: Scope | None = None, documented_nulls: bool = False) -> DataFrame:
    """Rows for which the condition holds and every mentioned column is non-null.

    With ``documented_nulls`` columns under NOT NULL stay out of the mask, so that NOT (c NOT NULL) finds nulls.
    """
    scope = scope or Scope(df)
    names = P.references(condition) | set(extra)
    if documented_nulls:
        names -= _null_tests(condition)
    if (m := mask(scope, names)) is not None:
        df = df.filter(m)
    return df if condition is None else df.filter(scope.condition(condition))


def _null_tests(node: Any) -> set[str]:
    if isinstance(node, P.NotNull):
        return P.references(node.arg)
    return set().union(*map(_null_tests, P.children(node)), set()) if node is not None else set()


def median(c: Column, kind: T.DataType) -> Column:
    """Doubles interpolate; whole numbers keep their type and truncate between the middle two."""
    if isinstance(kind, T.IntegralType):
        return F.percentile(c, 0.5).cast("long").cast(kind)  # the cast drops the fraction
    return F.percentile(c.cast("double"), 0.5)


def aggregate(scope: Scope, agg: P.Agg) -> Column:
    if P.has_aggregate(agg.arg):
        raise P.ParseError("aggregates cannot be nested")
    name = agg.name
    if name == "count":
        return F.count(F.lit(1))
    c = scope.value(agg.arg)
    x = scope.number(agg.arg)
    f = scope.find(agg.arg.name) if isinstance(agg.arg, P.Col) else None
    if name in ("min", "max"):
        return getattr(F, name)(c)
    if name == "sum":
        return F.sum(x)
    if name == "avg":
        return F.avg(x)
    if name == "median":
        return median(c, f.dataType if f else T.DoubleType())
    if name == "countd":
        return F.count_distinct(c)
    if name == "concat":
        return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v.cast("string")), ", ")
    if name == "var_pop":
        return F.var_pop(x)
    if name == "std_pop":
        return F.stddev_pop(x)
    return F.coalesce(F.var_samp(x) if name == "var_samp" else F.stddev_samp(x), F.when(F.count(x) > 0, F.lit(0.0)))


def name_of(term: P.Term, i: int) -> str:
    if term.alias:
        return term.alias
    if isinstance(term.expr, P.Col):
        return term.expr.name.rpartition(".")[2]
    return f"_{i:x}"


def _after(scope: Scope, node: Any, found: dict[P.Agg, str], df: DataFrame) -> Column:
    """A term over aggregates, once those are columns."""
    def swap(n: Any) -> Any:
        if isinstance(n, P.Agg):
            return P.Col(found[n])
        if isinstance(n, P.Bin):
            return P.Bin(n.op, swap(n.left), swap(n.right))
        if isinstance(n, P.Neg):
            return P.Neg(swap(n.arg))
        if isinstance(n, P.Call):
            return P.Call(n.name, tuple(map(swap, n.args)))
        return n

    return Scope(df, local_zone=scope.local_zone).value(swap(node))


def _aggs(node: Any) -> list[P.Agg]:
    return [node] if isinstance(node, P.Agg) else [a for c in P.children(node) for a in _aggs(c)]


def project(df: DataFrame, terms: list[P.Term], scope: Scope | None = None, ordered: bool = False) -> DataFrame:
    """The select list on rows that already qualify. Terms without aggregates are keys as soon as one term has one."""
    scope = scope or Scope(df)
    names = [name_of(t, i) for i, t in enumerate(terms)]
    if not any(P.has_aggregate(t.expr) for t in terms):
        out = []
        for t, n in zip(terms, names):
            out += ["*"] if isinstance(t.expr, P.Star) else [scope.value(t.expr).alias(n)]
        return df.select(*out)
    keys = [(t, n) for t, n in zip(terms, names) if not P.has_aggregate(t.expr)]
    aggs = list(dict.fromkeys(a for t in terms for a in _aggs(t.expr)))
    found = {a: f"_agg{i}" for i, a in enumerate(aggs)}
    grouped = df.groupBy(*[scope.value(t.expr).alias(n) for t, n in keys]).agg(*[aggregate(scope, a).alias(found[a]) for a in aggs])
    out = grouped.select(*[F.col(f"`{n}`") if not P.has_aggregate(t.expr) else _after(scope, t.expr, found, grouped).alias(n) for t, n in zip(terms, names)])
    return out if ordered or not keys else out.orderBy(*[F.col(f"`{n}`") for _, n in keys])


def order(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """By the named columns; with no names, by all integer columns, those of the fewest values first."""
    have = {c.lower(): c for c in df.columns}
    if not keys:
        ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
        if not ints:
            return df
        n = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in ints]).first()
        keys = [(c, True) for c in sorted(ints, key=lambda c: (n[c], c))]
    cols = []
    for name, up in keys:
        got = have.get(name.lower()) or have.get(name.rpartition(".")[2].lower())
        if got is None:
            raise P.ParseError(f"ORDER BY {name}: not in the select list")
        cols.append(F.col(f"`{got}`").asc() if up else F.col(f"`{got}`").desc())
    return df.orderBy(*cols)


def run(df: DataFrame, st: P.Statement, scope: Scope | None = None, condition: Any = None, documented_nulls: bool = False) -> DataFrame:
    """A whole statement over one relation (a table, or a join)."""
    scope = scope or Scope(df)
    terms = st.select or [P.Term(P.Agg("count", P.Star()), "count(*)")]
    aliases = {t.alias.lower(): t.expr for t in terms if t.alias and not P.has_aggregate(t.expr) and scope.find(t.alias) is None}
    condition = P.substitute(st.where if condition is None else condition, aliases)
    refs = set().union(*[P.references(t.expr) for t in terms])
    rows = restrict(df, condition, refs, scope, documented_nulls)
    out = project(rows, terms, scope, ordered=st.order is not None)
    if st.order is not None:
        out = order(out, st.order)
    if st.offset:
        out = out.offset(st.offset)
    return out if st.limit is None else out.limit(st.limit)
