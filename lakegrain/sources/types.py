"""Schemas written as ``name:type`` lists."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Loader names to Spark types; unsigned types widen.
TYPES = {
    "byte": T.ByteType(), "ubyte": T.ShortType(), "unsigned byte": T.ShortType(), "short": T.ShortType(), "halfword": T.ShortType(),
    "ushort": T.IntegerType(), "unsigned short": T.IntegerType(), "int": T.IntegerType(), "uint": T.LongType(), "unsigned int": T.LongType(), "unsigned": T.LongType(),
    "long": T.LongType(), "ulong": T.DecimalType(20, 0), "unsigned long": T.DecimalType(20, 0), "float": T.FloatType(), "real": T.FloatType(), "double": T.DoubleType(),
    "bit": T.BooleanType(), "oid": T.LongType(), "category": T.StringType(), "key": T.StringType(), "text": T.StringType(), "string": T.StringType(), "blob": T.BinaryType(),
}
_SHORT = {"b": "byte", "ub": "ubyte", "h": "short", "s": "short", "us": "ushort", "i": "int", "u": "uint", "ui": "uint", "l": "long", "ul": "ulong", "f": "float", "r": "real", "d": "double", "k": "key", "c": "category", "t": "text", "q": "blob"}
UNSIGNED = {"ubyte": 255, "ushort": 65535, "uint": 2**32 - 1}


def type_of(name: str) -> T.DataType:
    """An unknown name is int, as loaders have it."""
    low = " ".join(name.lower().split())
    low = _SHORT.get(low, low)
    return TYPES.get(low) or next((t for k, t in TYPES.items() if low and k.startswith(low)), T.IntegerType())


def schema(text: str) -> T.StructType:
    """``a:int, b:double`` or with blanks for commas; a name without a type is int."""
    fields = [m for m in re.finditer(r"([A-Za-z_]\w*)\s*(?::\s*((?:unsigned\s+)?[A-Za-z]+))?", text)]
    return T.StructType([T.StructField(m[1], type_of(m[2] or "int")) for m in fields])
