"""Arithmetic and scalar functions on doubles, with the dialect's own corner cases."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def num(c: Column) -> Column:
    return c.cast("double")


def _flag(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """0 when either side is 0."""
    return F.when((a != 0) & (b != 0), a / b).otherwise(F.lit(0.0))


def modulo(a: Column, b: Column) -> Column:
    return F.when((a != 0) & (b != 0), a % b).otherwise(F.lit(0.0))


def power(a: Column, b: Column) -> Column:
    """0 ** y is 0, x ** 0 is 1 for other x."""
    return F.when(a == 0, F.lit(0.0)).otherwise(F.pow(a, b))


def _bits(x: Column) -> Column:
    """The long with the bits of x as an unsigned number of 64 bits; larger numbers have all bits set."""
    return F.when(x >= 2.0**64, F.lit(-1)).when(x >= 2.0**63, (x - F.lit(2.0**64)).cast("long")).otherwise(x.cast("long"))


def _unsigned(x: Column) -> Column:
    return F.when(x < 0, num(x) + F.lit(2.0**64)).otherwise(num(x))


def bit_and(a: Column, b: Column) -> Column:
    return _unsigned(_bits(num(a)).bitwiseAND(_bits(num(b))))


def bit_or(a: Column, b: Column) -> Column:
    return _unsigned(_bits(num(a)).bitwiseOR(_bits(num(b))))


OPERATORS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": divide, "%": modulo, "**": power, "&": bit_and, "|": bit_or,
}


def _log(f):
    def g(x: Column) -> Column:
        return F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))

    return g


def _whole(f):
    """floor or ceil; doubles from 2**52 on are whole already, and need not fit a long."""
    return lambda x: F.when(F.abs(num(x)) >= 2.0**52, num(x)).otherwise(num(f(x)))


floor, ceil = _whole(F.floor), _whole(F.ceil)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, floor(x)).otherwise(ceil(x))


def round1(x: Column) -> Column:
    return F.when(F.abs(num(x)) >= 2.0**52, num(x)).otherwise(floor(x + 0.5))


def frexp(x: Column) -> Column:
    """The mantissa, from 0.5 to 1: the logarithm may be off by one beside powers of two, the mantissa is not."""
    x = num(x)
    near = F.when(F.abs(x) > 2.0**1000, x * 2.0**-200).when(F.abs(x) < 2.0**-900, x * 2.0**200).otherwise(x)
    m = near / F.pow(F.lit(2.0), F.floor(F.log2(F.abs(near))) + 1)
    m = F.when(F.abs(m) >= 1, m / 2).when(F.abs(m) < 0.5, m * 2).otherwise(m)
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(m)


def round2(x: Column, n: Column) -> Column:
    p = F.pow(F.lit(10.0), num(n.cast("long")))
    return F.when(F.abs(x * p) >= 2.0**52, num(x)).otherwise(floor(0.5 + x * p) / p)


ONE = {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": ceil, "cos": F.cos, "cosh": F.cosh,
    "exp": F.exp, "fabs": F.abs, "abs": F.abs, "floor": floor, "frexp": frexp,
    "is_zero": lambda x: _flag(x == 0), "is_nonzero": lambda x: _flag(x != 0), "log": _log(F.log), "log10": _log(F.log10),
    "modf": lambda x: x - trunc(x), "round": round1, "int_from_dict": round1, "sin": F.sin, "sinh": F.sinh,
    "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "trunc": trunc,
}

TWO = {
    "atan2": F.atan2, "fmod": lambda a, b: F.when(b != 0, a % b).otherwise(F.lit(NAN)),
    "ldexp": lambda a, b: a * F.pow(F.lit(2.0), num(b.cast("int"))), "pow": F.pow, "power": F.pow,
    "round": round2, "round2": round2, "trunc": round2, "is_eql": lambda a, b: _flag(a == b),
    "is_gte": lambda a, b: _flag(a >= b), "is_lte": lambda a, b: _flag(a <= b),
}

#: Constants fold before the plan is made.
FOLD = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if a and b else 0.0, "%": lambda a, b: math.fmod(a, b) if a and b else 0.0, "**": lambda a, b: 0.0 if a == 0 else a**b}


def folded(op: str, a: float, b: float) -> float | None:
    """The constant, or None where Python has no finite real one and the engine's arithmetic decides."""
    try:
        got = FOLD[op](a, b)
    except (OverflowError, ZeroDivisionError, ValueError):
        return None
    return got if isinstance(got, float) and math.isfinite(got) else None
