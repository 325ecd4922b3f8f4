"""Lowers parsed conditions and terms to Spark columns."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar, time
from ..operators.text import tokens as text_tokens
from . import parse as P

_NUMERIC = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
_TIMES = {"from_unixtime_gmt", "from_unixtime_local", "strptime", "to_unixtime_gmt", "to_unixtime_local", "iso_to_unixtime_gmt", "iso_to_unixtime_local", "format_unixtime_gmt", "format_unixtime_local"}
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


def like_regex(pattern: str) -> str:
    """Whole-string pattern: % and * any run, _ and ? one character, backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c in "%*" else "." if c in "_?" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


class Scope:
    """Names of a relation. Qualified names (t.c) resolve by alias; case does not matter."""

    def __init__(self, df: DataFrame, aliases: dict[str, list[str]] | None = None, local_zone: str = "UTC"):
        self.df, self.local_zone = df, local_zone
        self.types = {f.name.lower(): f for f in df.schema.fields}
        self.aliases = {k.lower(): {c.lower(): name for c, name in v} for k, v in (aliases or {}).items()}
        self.session_zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def find(self, name: str) -> T.StructField | None:
        low = name.lower()
        if low in self.types:
            return self.types[low]
        if "." in low:
            table, _, col = low.rpartition(".")
            if self.aliases:
                got = self.aliases.get(table, {}).get(col)
                return self.types.get(got.lower()) if got else None
            return self.types.get(col)
        for names in self.aliases.values():  # the left table first
            if low in names:
                return self.types.get(names[low].lower())
        return None

    def column(self, name: str) -> Column:
        f = self.find(name)
        if f is None:
            raise P.ParseError(f"no column {name!r}; there are {', '.join(x.name for x in self.types.values())}")
        return F.col(f"`{f.name}`")

    # terms
    def is_text(self, node: Any) -> bool:
        if isinstance(node, P.Str):
            return True
        if isinstance(node, P.Call):
            return node.name.startswith("format_unixtime")
        f = self.find(node.name) if isinstance(node, P.Col) else None
        return f is not None and not isinstance(f.dataType, _NUMERIC)

    def value(self, node: Any) -> Column:
        """A select term as it is: columns keep their type."""
        return self.column(node.name) if isinstance(node, P.Col) else F.lit(node.value) if isinstance(node, P.Str) else self.number(node)

    def number(self, node: Any) -> Column:
        """Any term as a double."""
        node = fold(node)
        if isinstance(node, P.Num):
            return F.lit(float(node.value))
        if isinstance(node, P.Str):
            return F.lit(node.value)
        if isinstance(node, P.Col):
            f = self.find(node.name)
            c = self.column(node.name)
            return c.cast("timestamp").cast("double") if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)) else c.cast("double") if isinstance(f.dataType, _NUMERIC) else c.try_cast("double")
        if isinstance(node, P.Neg):
            return -self.number(node.arg)
        if isinstance(node, P.Bin):
            return scalar.OPERATORS[node.op](self.number(node.left), self.number(node.right))
        if isinstance(node, P.Call):
            return self.call(node)
        if isinstance(node, P.Agg):
            raise P.ParseError("an aggregate may stand in the select list only, and not in another aggregate")
        return self.condition(node).cast("double")

    def call(self, node: P.Call) -> Column:
        name, args = node.name, node.args
        if name in _TIMES:
            zone = "UTC" if name.endswith("gmt") else self.local_zone
            text = [a.value if isinstance(a, P.Str) else None for a in args]
            if name.startswith("to_unixtime"):
                return F.lit(time.constant(text[0], text[1], zone))
            t = self.number(args[0])
            if name.startswith("iso"):
                return time.iso(t, zone)
            if name.startswith("format"):
                return time.format_time(t, text[1], zone, self.session_zone)
            return time.extract(t, text[1], zone, self.session_zone)
        table = scalar.ONE if len(args) == 1 else scalar.TWO if len(args) == 2 else {}
        if name not in table:
            raise P.ParseError(f"no function {name} of {len(args)} arguments")
        return table[name](*map(self.number, args))

    # conditions
    def condition(self, node: Any) -> Column:
        if isinstance(node, P.Logic):
            a, b = self.condition(node.left), self.condition(node.right)
            return {"and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "minus": lambda: a & ~b}[node.op]()
        if isinstance(node, P.Not):
            return ~self.condition(node.arg)
        if isinstance(node, P.Cmp):
            return self.compare(node.op, node.left, node.right)
        if isinstance(node, P.In):
            return self.member(node)
        if isinstance(node, P.Like):
            return self.like(node)
        if isinstance(node, P.Contains):
            words = text_tokens(self.value(node.arg).cast("string"))
            return reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in node.words], F.lit(True))
        if isinstance(node, P.NotNull):
            return self.value(node.arg).isNotNull()
        if isinstance(node, P.Exists):
            return F.lit(self.find(node.name) is not None)
        if isinstance(node, P.AnyOf):
            cols = [f for k, f in self.types.items() if k.startswith(node.prefix.lower()) and isinstance(f.dataType, T.NumericType)]
            hits = [F.coalesce(F.col(f"`{f.name}`").isin([literal(v, f.dataType) for v in node.values]), F.lit(False)) for f in cols]
            return reduce(lambda a, b: a | b, hits, F.lit(False))
        return self.number(node) != 0

    def like(self, node: P.Like) -> Column:
        c = self.value(node.arg).cast("string")
        body = node.pattern.rstrip("%*")
        if body and not re.search(r"[%*_?\\]", body) and len(body) < len(node.pattern):
            return c.startswith(body)  # reaches the scan as a prefix filter
        if not re.search(r"[%*_?\\]", node.pattern):
            return c == node.pattern
        return c.rlike(like_regex(node.pattern))

    def compare(self, op: str, a: Any, b: Any) -> Column:
        a, b = fold(a), fold(b)
        for x, y, o in ((a, b, op), (b, a, _FLIP[op])):
            # a bare word or string beside a column is a string when the column is text
            if isinstance(x, P.Col) and self.find(x.name) is not None and isinstance(y, (P.Str, P.Num, P.Col)):
                kind = self.find(x.name).dataType
                if isinstance(y, P.Col) and self.find(y.name) is None:
                    y = P.Str(y.name)
                if isinstance(y, (P.Str, P.Num)):
                    if not isinstance(kind, _NUMERIC):
                        if isinstance(y, P.Str):
                            return _op(o, self.column(x.name), F.lit(y.value))
                        return _op(o, self.number(x), F.lit(float(y.value)))
                    if isinstance(y, P.Str):
                        try:
                            y = P.Num(float(y.value))
                        except ValueError:
                            return F.lit(o == "!=")
                    if isinstance(kind, T.NumericType):
                        return _op(o, self.column(x.name), literal(y, kind))
                    return _op(o, self.number(x), F.lit(float(y.value)))
        if self.is_text(a) or self.is_text(b):
            return _op(op, self.value(a).cast("string"), self.value(b).cast("string"))
        if isinstance(a, P.Col) and isinstance(b, P.Col):
            return _op(op, self.value(a), self.value(b))
        return _op(op, self.number(a), self.number(b))

    def member(self, node: P.In) -> Column:
        values = [fold(v) for v in node.values]
        if not values:
            return F.lit(False)
        f = self.find(node.arg.name) if isinstance(node.arg, P.Col) else None
        if f is not None and not isinstance(f.dataType, _NUMERIC) or f is None and self.is_text(node.arg):
            return self.value(node.arg).isin([str(v.value) if isinstance(v, P.Str) else v.name if isinstance(v, P.Col) else f"{v.value:g}" for v in values])
        values = [P.Num(float(v.value)) if isinstance(v, P.Str) else v for v in values]
        if f is not None and isinstance(f.dataType, T.NumericType):
            return self.column(f.name).isin([literal(v, f.dataType) for v in values])
        return self.number(node.arg).isin([float(v.value) for v in values])


def _op(op: str, a: Column, b: Column) -> Column:
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def literal(v: P.Num, kind: T.DataType) -> Column:
    """A number beside a column, typed so that the comparison is exact and reaches the scan."""
    x = v.value
    if v.exact:
        return F.lit(x) if isinstance(x, Decimal) else F.lit(x).cast("long")
    if isinstance(kind, (T.IntegralType, T.DecimalType)) and float(x).is_integer() and abs(x) < 2**53:
        return F.lit(int(x))
    return F.lit(float(x))


def fold(node: Any) -> Any:
    """Constant folding of arithmetic."""
    if isinstance(node, P.Neg):
        arg = fold(node.arg)
        return P.Num(-arg.value, arg.exact) if isinstance(arg, P.Num) else P.Neg(arg)
    if isinstance(node, P.Bin):
        a, b = fold(node.left), fold(node.right)
        if isinstance(a, P.Num) and isinstance(b, P.Num) and node.op in scalar.FOLD:
            got = scalar.folded(node.op, float(a.value), float(b.value))
            if got is not None:
                return P.Num(got)
        return P.Bin(node.op, a, b)
    return node
