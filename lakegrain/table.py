"""The table facade: what a user of the dialect works with."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .operators import histogram as H
from .plans import parse as P
from .plans import select as S
from .sources import readers


class Table:
    """A relation and the dialect's operations on it; each gives a new table."""

    def __init__(self, df: DataFrame, name: str = "T"):
        self.df, self.name = df, name

    # relations
    def select(self, terms: str = "", where: str | Column | None = None, documented_nulls: bool = False) -> Table:
        """Terms without aggregates are group keys as soon as one term has one. No terms: the number of rows."""
        if isinstance(where, Column):
            return Table(S.run(self.df.filter(where), P.Statement(P.parse_select(terms))), self.name)
        st = P.Statement(P.parse_select(terms), where=P.parse_condition(where))
        return Table(S.run(self.df, st, documented_nulls=documented_nulls), self.name)

    def groupby(self, terms: str) -> Table:
        return self.select(terms)

    def orderby(self, keys: str = "") -> Table:
        return Table(S.order(self.df, P.parse_order(keys)), self.name)

    def reverse(self, keys: str) -> Table:
        """Rows in the opposite order of the keys; rows of a relation have no order of their own."""
        return Table(S.order(self.df, [(n, not up) for n, up in P.parse_order(keys)]), self.name)

    def limit(self, n: int, offset: int = 0) -> Table:
        return Table(readers.part(self.df, n, offset), self.name)

    def topk(self, k: int, keys: str) -> Table:
        return self.orderby(keys).limit(k)

    def rename(self, names: dict[str, str]) -> Table:
        return Table(self.df.withColumnsRenamed(names), self.name)

    def add_column(self, expression: str, name: str) -> Table:
        from .plans.lower import Scope

        return Table(self.df.withColumn(name, Scope(self.df).value(P.parse_select(expression)[0].expr)), self.name)

    def append(self, other: Table) -> Table:
        return Table(self.df.unionByName(other.df, allowMissingColumns=True), self.name)

    def restrict_to(self, ids: DataFrame, column: str) -> Table:
        """Rows whose row identifier is in a set."""
        return Table(self.df.join(ids, column, "left_semi"), self.name)

    # sizes
    def count(self, where: str | None = None) -> int:
        return S.restrict(self.df, P.parse_condition(where)).count()

    def estimate(self, where: str | None = None) -> tuple[int, int]:
        """Bounds on the number of hits; here both are exact."""
        n = self.count(where)
        return n, n

    def bounds(self, column: str) -> Row:
        """min, max and sum of a column."""
        c = F.col(column).cast("double")
        return self.df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum")).first()

    # description
    def names(self) -> list[str]:
        return self.df.columns

    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def describe(self) -> str:
        return f"{self.name}\n" + "\n".join(f"  {n}: {t}" for n, t in self.df.dtypes)

    # values
    def column(self, name: str, begin: int = 0, end: int | None = None) -> list[Any]:
        df = self.df.select(name)
        return [r[0] for r in readers.part(df, None if end is None else end - begin, begin).toLocalIterator()]

    def cursor(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def dump(self, path: str, kind: str = "csv", **options) -> None:
        {"csv": readers.dump_csv, "json": readers.dump_json}[kind](self.df, path, **options)

    def backup(self, path: str) -> None:
        self.df.write.parquet(path)

    # histograms
    def _where(self, where: str | None) -> DataFrame:
        return S.restrict(self.df, P.parse_condition(where))

    def histogram(self, *axes: H.Axis, where: str | None = None, weight: str | None = None) -> DataFrame:
        return H.histogram(self._where(where), list(axes), weight)

    def bins(self, *axes: H.Axis, row_id: str, where: str | None = None, weight: str | None = None) -> DataFrame:
        return H.bins(self._where(where), list(axes), row_id, weight)

    def adaptive(self, columns: list[str], n: list[int], where: str | None = None, weight: str | None = None) -> DataFrame:
        return H.adaptive(self._where(where), columns, n, weight)

    def cumulative(self, axis: H.Axis, where: str | None = None) -> DataFrame:
        return H.cumulative(self._where(where), axis)


def concat(*tables: Table) -> Table:
    return reduce(Table.append, tables)
