"""CSV, SQL dumps, in-memory rows; writers for CSV, JSON and Parquet."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import schema as parse_schema
from .types import type_of


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiters: str = ",", null: str = "") -> DataFrame:
    """Lines as rows; # begins a comment, values that do not parse are null, blanks around values do not count.

    One delimiter is read by Spark's CSV reader; of several characters, any run of them separates.
    """
    st = parse_schema(schema) if isinstance(schema, str) else schema
    if len(delimiters) == 1 and delimiters != " ":
        r = spark.read.schema(st).option("sep", delimiters).option("comment", "#").option("mode", "PERMISSIVE").option("nullValue", null)
        return r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", "\\").csv(path)
    cls = "[" + re.escape(delimiters) + "]+"
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.regexp_replace("value", f"^{cls}|{cls}$", ""), cls)
    return lines.select(*[value(F.get(parts, F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(st.fields)])


def value(c: Column, kind: T.DataType) -> Column:
    c = F.trim(F.regexp_replace(c, r"""^['"]|['"]$""", ""))
    return F.when(c != "", c) if isinstance(kind, T.StringType) else c.try_cast(kind)


_CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?\s*\((.*?)\)\s*[^();]*;", re.I | re.S)
_TYPE = [("tinyint", "byte"), ("smallint", "short"), ("mediumint", "int"), ("bigint", "long"), ("int", "int"), ("float", "float"), ("real", "double"), ("double", "double"), ("decimal", "double"), ("numeric", "double"), ("char", "key"), ("varchar", "key"), ("enum", "key"), ("date", "key"), ("time", "key"), ("text", "text"), ("blob", "blob")]


def dump_schema(text: str) -> tuple[str, T.StructType, dict[str, str]]:
    """Name, columns and defaults of the CREATE TABLE statement of a dump."""
    m = _CREATE.search(text)
    if not m:
        raise ValueError("the dump has no CREATE TABLE")
    fields, defaults = [], {}
    for line in re.split(r",(?![^(]*\))", m[2]):
        w = re.match(r"\s*[`\"]?(\w+)[`\"]?\s+(\w+)(.*)", line, re.S)
        if not w or w[1].lower() in ("primary", "key", "unique", "index", "constraint", "fulltext", "foreign"):
            continue
        kind = next((t for k, t in _TYPE if w[2].lower().startswith(k)), "text")
        if "unsigned" in w[3].lower() and kind in ("byte", "short", "int", "long"):
            kind = "u" + kind
        fields.append(T.StructField(w[1], type_of(kind)))
        if d := re.search(r"default\s+('(?:[^']|'')*'|\S+)", w[3], re.I):
            if d[1].lower() != "null":
                defaults[w[1]] = d[1].strip("'")
    return m[1], T.StructType(fields), defaults


def _values(line: str) -> list[list[str | None]]:
    """The tuples of an INSERT statement."""
    at = re.search(r"\bvalues\b", line, re.I)
    rows, row, cur, quoted, was = [], None, [], False, False
    i, s = 0, line[at.end() :] if at else ""
    while i < len(s):
        c = s[i]
        if quoted:
            if c == "\\" and i + 1 < len(s):
                i += 1
                cur.append({"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(s[i], s[i]))
            elif c == "'" and s[i + 1 : i + 2] == "'":
                cur.append("'")
                i += 1
            elif c == "'":
                quoted = False
            else:
                cur.append(c)
        elif c == "'":
            quoted = was = True
        elif c == "(" and row is None:
            row, cur, was = [], [], False
        elif c in ",)" and row is not None:
            t = "".join(cur) if was else "".join(cur).strip()
            row.append(None if not was and t.upper() in ("NULL", "") else t)
            cur, was = [], False
            if c == ")":
                rows.append(row)
                row = None
        elif row is not None:
            cur.append(c)
        i += 1
    return rows


def read_sql_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump of one table: statements end with ``;`` at the end of a line. INSERTs are parsed on the executors."""
    st = spark.read.option("lineSep", ";\n").text(path)
    head = st.filter(F.lower("value").contains("create table")).first()
    if head is None:
        raise ValueError("the dump has no CREATE TABLE")
    _, schema, defaults = dump_schema(head[0] + ";")
    names = re.compile(r"insert\s+into\s+\S+\s*\(([^)]*)\)\s*values", re.I)

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                m = names.search(text)
                order = [x.strip(" `\"") for x in m[1].split(",")] if m else [f.name for f in schema.fields]
                for row in _values(text):
                    got = dict(zip(order, row))
                    out.append([got.get(f.name, defaults.get(f.name)) if f.name not in got else got[f.name] for f in schema.fields])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["v"])

    inserts = st.filter(F.lower(F.ltrim("value")).rlike(r"^(--.*\n|\s)*insert\s")).mapInArrow(rows, "v array<string>")
    cols = [(F.col("v")[i] if isinstance(f.dataType, T.StringType) else F.col("v")[i].try_cast(f.dataType)).alias(f.name) for i, f in enumerate(schema.fields)]
    return inserts.select(*cols)


def from_rows(spark: SparkSession, data: Any, schema: str | None = None) -> DataFrame:
    """Rows, pandas, Arrow or a dict of columns as a relation."""
    if isinstance(data, dict):
        import pandas as pd

        data = pd.DataFrame(data)
    return spark.createDataFrame(data, parse_schema(schema) if schema else None)


def dump_csv(df: DataFrame, path: str, sep: str = ",", limit: int | None = None, offset: int = 0) -> None:
    part(df, limit, offset).write.option("sep", sep).option("header", False).csv(path)


def dump_json(df: DataFrame, path: str, limit: int | None = None, offset: int = 0) -> None:
    part(df, limit, offset).write.option("ignoreNullFields", False).json(path)


def part(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
