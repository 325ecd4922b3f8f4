"""Keyword search: tokens, term-document pairs, external term lists, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between keywords; a quoted stretch is one keyword.
DELIMITERS = ";, \x0b\x08\x0c\r\t\n'\""
_QUOTED = r"""'[^']*'|"[^"]*"|[^;, \x0B\x08\f\r\t\n'"]+"""
_UNQUOTED = r"[;, \x0B\x08\f\r\t\n]+"


def tokens(text: Column, delimiters: str | None = None) -> Column:
    """Keywords of a text. Without quotes in it this is a split; quoted keywords may hold delimiters."""
    if delimiters is not None:
        cls = "[" + "".join("\\" + c if not c.isalnum() and c.isprintable() else c for c in delimiters) + "]+"
        return F.filter(F.split(text, cls), lambda x: x != "")
    # most texts have no quote: one split, no step for each keyword
    plain = F.array_remove(F.split(text, _UNQUOTED), "")
    found = F.regexp_extract_all(text, F.lit("(" + _QUOTED + ")"), 1)
    quoted = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"""^['"]|['"]$""", ""))), lambda x: x != "")
    return F.when(text.contains("'") | text.contains('"'), quoted).otherwise(plain)


#: Documents whose ids fall in a bucket with an id of several rows are looked at together; so many numbers are sent to all at most.
BUCKETS = 1 << 20


def _term_rows(df: DataFrame, text: str, doc: str, delimiters: str | None) -> tuple[DataFrame, DataFrame]:
    """(term, doc), each once: of documents of one row, which need no exchange, and of the others."""
    bucket = F.pmod(F.xxhash64(doc), F.lit(BUCKETS))
    several = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(bucket.alias("_bucket")).distinct()

    def rows(how: str) -> DataFrame:
        some = df.join(F.broadcast(several), bucket == F.col("_bucket"), how)
        return some.select(F.explode(F.array_distinct(tokens(F.col(text), delimiters))).alias("term"), F.col(doc).alias("doc"))

    return rows("left_anti"), rows("left_semi").distinct()


def term_document(df: DataFrame, text: str, doc: str, delimiters: str | None = None) -> DataFrame:
    """(term, doc), each pair once."""
    one, several = _term_rows(df, text, doc, delimiters)
    return one.unionByName(several)


def keyword_counts(df: DataFrame, text: str, doc: str, delimiters: str | None = None) -> DataFrame:
    """(term, n_docs)."""
    return term_document(df, text, doc, delimiters).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def search(df: DataFrame, text: str, words: list[str], delimiters: str | None = None) -> DataFrame:
    """Rows whose text has all the keywords."""
    found = tokens(F.col(text), delimiters)
    out = df
    for w in words:
        out = out.filter(F.array_contains(found, w))
    return out


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc) of a term list file: lines ``term: doc doc ..``; # begins a comment."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").contains(":"))
    term = F.trim(F.regexp_replace(F.regexp_extract("value", r"^(.*):[^:]*$", 1), r"""^\s*['"]|['"]\s*$""", ""))
    docs = F.filter(F.split(F.regexp_extract("value", r":([^:]*)$", 1), r"[,\s]+"), lambda x: x != "")
    return lines.select(term.alias("term"), F.explode(docs).alias("_d")).select("term", F.col("_d").cast("long").alias("doc")).distinct()


def search_terms(df: DataFrame, terms: DataFrame, doc: str, words: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``doc`` has all the keywords in a term-document table."""
    words = sorted(set(words))
    hit = terms.filter(F.col("term").isin(words)).groupBy(F.col("doc").alias(doc)).agg(F.count_distinct("term").alias("_n")).filter(F.col("_n") == len(words)).select(doc)
    return df.join(hit, doc, "left_semi")
