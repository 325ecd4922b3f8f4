"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, salt, staged, tree_merge, without_rows

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without the characters of ``BLANKS``; a
    null text counts as empty, so nulls, empty and blank texts form one group.  Of
    equal texts the one with the most code points stays, then the smallest id (a
    null id comes last).  Rows that agree in id and text are one record written
    twice: each is returned, and exactly one is kept.  Other columns of ``docs`` are not read,
    so their names cannot clash; an empty table gives an empty result.

    Each partition makes sorted runs of digests; :func:`tree_merge` merges runs in
    rounds.  At every level the row to keep travels with its digest, and a run only
    merges with one that also agrees in a second hash and in the length.
    """
    return _judged(docs, F.monotonically_increasing_id(), id_col, text_col).drop("_row")


def _judged(docs: DataFrame, number: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of :func:`exact_dedup` with ``_row``, the number of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(bare, 256)).alias("_digest"),
        F.xxhash64(bare).alias("_check"),
        F.length(text).alias("_len"),
        number.alias("_row"),
    )
    rows = rows.withColumn("_salt", salt("doc_id", "_row"))
    rows = staged(rows, "digests")
    # greatest first: length, then the smallest id, then the first row
    best = F.struct(F.col("_len"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("id"), (-F.col("_row")).alias("row"))
    out = tree_merge(rows, ["_digest", "_check"], best, "_best", rounds=2)
    return out.select(
        "_row",
        "doc_id",
        (-F.col("_best.id")).alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == -F.col("_best.row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns. Rows go by their number, whatever their ids are."""
    rows, name = numbered(docs)
    gone = _judged(rows, F.col(name)).filter(~F.col("kept"))
    return without_rows(rows, name, gone.select(F.col("_row").alias(name)))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS kept,
       h AS text_sha256
FROM t
"""
