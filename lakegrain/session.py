"""The engine: a registry of relations and the dialect's statements over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .operators.join import join
from .plans import parse as P
from .plans import select as S
from .plans.lower import like_regex
from .sources import readers
from .sources.store import Store, open_folder
from .table import Table


class Engine:
    def __init__(self, spark: SparkSession, local_zone: str = "UTC"):
        self.spark, self.local_zone = spark, local_zone
        self.tables: dict[str, DataFrame] = {}
        self.lazy: dict[str, Callable[[], DataFrame]] = {}

    def register_lazy(self, name: str, opener: Callable[[], DataFrame]) -> None:
        """A table that is opened when a statement first names it."""
        self.tables.pop(name.lower(), None)
        self.lazy[name.lower()] = opener

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.lazy[name]()
        return self.tables[name]

    def register(self, name: str, df: DataFrame) -> Table:
        self.tables[name.lower()] = df
        return Table(df, name)

    def drop(self, name: str) -> None:
        self.tables.pop(name.lower(), None)
        self.lazy.pop(name.lower(), None)

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.lazy})

    def open(self, path: str, name: str) -> Table:
        return self.register(name, open_folder(self.spark, path))

    def open_store(self, path: str) -> Store:
        """Each partition of a store becomes a table by its own name."""
        store = Store(self.spark, path)
        for p in store.partitions():
            self.register(p, store.read(p.replace("_", r"\_")))
        return store

    def read_csv(self, path: str, schema: str, name: str, delimiters: str = ",") -> Table:
        return self.register(name, readers.read_csv(self.spark, path, schema, delimiters))

    def read_sql_dump(self, path: str, name: str) -> Table:
        return self.register(name, readers.read_sql_dump(self.spark, path))

    def relation(self, pattern: str) -> DataFrame:
        """A table, or all tables that a name with % or _ matches, one after the other."""
        if pattern.lower() in self.names():
            return self.table(pattern.lower())
        rx = re.compile(like_regex(pattern.lower()))
        found = [self.table(n) for n in self.names() if rx.match(n)]
        if not found:
            raise P.ParseError(f"no table {pattern!r}; there are {', '.join(self.names())}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def sql(self, text: str, documented_nulls: bool = False) -> DataFrame:
        """[SELECT terms] FROM tables [WHERE condition] [ORDER BY keys] [LIMIT [offset,] n]; no FROM: all tables."""
        st = P.parse_statement(text)
        sources = st.sources or [P.Source("%", "T")]
        if len(sources) == 1:
            df = self.relation(sources[0].name)
            return S.run(df, st, S.Scope(df, local_zone=self.local_zone), documented_nulls=documented_nulls)
        refs = set().union(*[P.references(t.expr) for t in st.select], set())
        cond = st.on if st.where is None else st.where if st.on is None else P.Logic("and", st.on, st.where)
        df, scope = join([(s.alias, self.relation(s.name)) for s in sources], cond, st.using, refs, self.local_zone)
        return S.run(df, P.Statement(st.select, order=st.order, limit=st.limit, offset=st.offset), scope)
