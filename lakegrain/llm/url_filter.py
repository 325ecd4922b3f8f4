"""URL filters as a sort-merge range join.

A host reversed label by label ("com.example.www.") makes all subdomains of a
rule's host one interval of keys.  Pages and rules are dealt to key ranges, each
range is sorted and swept once, and the sweep keeps the stack of rule hosts whose
interval is open.  A range is cut by key and a hash of the page id, so pages of
one hot host go to many tasks; a rule is copied to each range that its interval
meets (at most the number of ranges).
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the production query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"
#: Ranges for each shuffle partition, and sampled keys for each range (they only balance the ranges).
RANGES, SAMPLE = 2, 50
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains where
    the url's path starts with its path; the longest host and path together wins, then the longest
    host; of two verdicts on one host and path, block.  Null hosts or paths of rules count as empty, and an
    empty host fits only urls without a host.  Urls that no rule fits get ``default``
    and a null rule.  Repeated and null page ids are rows like others; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit("."))
    rows = rows.withColumn("key", F.concat(key, F.lit("\x00"), F.lower(F.hex(F.xxhash64("page_id", "path")))))
    cuts = _cuts(rows.select("key"), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(batch: pa.RecordBatch):
        keys = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], ["page_id", "host", "path", "key", "range"])

    def place_rules(batch: pa.RecordBatch):
        out: list[list] = [[], [], [], [], []]
        for h, p, v in zip(*(c.to_pylist() for c in batch.columns)):
            h, p = (h or "").translate(str.maketrans(_UP, _LOW)), p or ""
            k = reversed_host(h)
            for r in range(bisect_right(cuts, k), bisect_right(cuts, k + "\U0010ffff") + 1):
                for x, y in zip(out, (h, p, k, r, v)):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())], ["host", "path", "key", "range", "verdict"])

    left = rows.select("key", "page_id", "host", "path").mapInArrow(lambda bs: (y for b in bs for y in place(b)), "page_id long, host string, path string, key string, range int")
    right = rules.select("host", "path", "verdict").mapInArrow(lambda bs: (y for b in bs for y in place_rules(b)), "host string, path string, key string, range int, verdict string")
    both = left.withColumn("verdict", F.lit(None).cast("string")).withColumn("is_rule", F.lit(False)).unionByName(
        right.withColumn("page_id", F.lit(None).cast("long")).withColumn("is_rule", F.lit(True))
    )
    swept = both.select("range", "key", "is_rule", "page_id", "host", "path", "verdict").repartition("range").sortWithinPartitions("range", "key")

    def sweep(batches):
        at, stack = None, []  # (host key, host, {path: verdict})
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r, k, is_rule, page, h, p, v in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    at, stack = r, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if is_rule:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, h, {}))
                    old = stack[-1][2].get(p)
                    stack[-1][2][p] = v if old is None else max(old, v)
                    continue
                best = None
                for _, rh, paths in stack:
                    for n in {len(x) for x in paths}:
                        if n <= len(p) and p[:n] in paths and (best is None or (len(rh) + n, len(rh)) > best[0]):
                            best = (len(rh) + n, len(rh)), rh + p[:n], paths[p[:n]]
                for x, y in zip(out, (page, h, p, best and best[1], best[2] if best else default)):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def _cuts(keys: DataFrame, ranges: int) -> list[str]:
    """Keys that cut the pages into about equal ranges, from a sample of at most some SAMPLE keys for each."""
    n = keys.count()
    most = SAMPLE * ranges
    got = sorted(r[0] for r in (keys if n <= most else keys.sample(most / n, 7)).collect())
    return [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []


def rules_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT u.page_id, max_by(r.rh || r.rp, length(r.rh || r.rp)) AS rule, max_by(v, length(r.rh || r.rp)) AS verdict
      FROM u JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
