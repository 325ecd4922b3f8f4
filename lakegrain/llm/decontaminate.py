"""Benchmark decontamination by a broadcast hash set of word windows.

Windows of the benchmark are few and their number is counted before they are
broadcast.  Beyond ``BLOCK`` windows the benchmark is taken in blocks of items,
each block is scanned for against all documents, and adds its hits to those of the
row, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, chunk_words, discard, map_arrow, staged, windows

#: Words of a window, and windows in one broadcast (some 200 bytes each).
WINDOW, BLOCK = 10, 1_000_000
WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
_BITS = 1 << 22
SCHEMA = "doc_id long, n_words long, spans array<struct<first:int,last:int,start:long,stop:long>>, items array<string>"


class WindowSet:
    """Windows of items by length in words; what tasks look hits up in."""

    def __init__(self, rows: list[tuple], window: int):
        texts = pa.array([t or "" for _, t in rows], pa.large_string())
        self.items: dict[bytes, set[str]] = {}
        by_len: dict[int, list[np.ndarray]] = {}
        for row, n, low, starts, stops, first, hashes, bounds in chunk_words(texts, WORD):
            for k in range(n):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    continue
                size = min(window, b - a)
                ws = [low[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist())]
                for i in range(len(ws) - size + 1):
                    self.items.setdefault(b" ".join(ws[i : i + size]), set()).add(str(rows[row + k][0]))
                by_len.setdefault(size, []).append(windows(hashes[a:b], size))
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in by_len.items()}
        self.bits = {}
        for size, h in self.hashes.items():
            self.bits[size] = np.zeros(_BITS, bool)
            self.bits[size][(h >> np.uint64(40)) & np.uint64(_BITS - 1)] = True


def _scan(batch: pa.RecordBatch, found: WindowSet):
    ids, texts = batch.column(0), batch.column(1)
    for row, n, low, starts, stops, first, hashes, bounds in chunk_words(texts, WORD):
        hit = np.zeros(len(starts), bool)
        items: dict[int, set[str]] = {}
        for size, sought in found.hashes.items():
            h = windows(hashes, size)
            at = np.flatnonzero(found.bits[size][(h >> np.uint64(40)) & np.uint64(_BITS - 1)])
            at = at[sought[np.minimum(np.searchsorted(sought, h[at]), len(sought) - 1)] == h[at]]
            text = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[text + 1]
            for i, k in zip(at[inside].tolist(), text[inside].tolist()):
                key = b" ".join(low[x:y].tobytes() for x, y in zip(starts[i : i + size].tolist(), stops[i : i + size].tolist()))
                if (got := found.items.get(key)) is not None:  # verified on the words themselves
                    hit[i : i + size] = True
                    items.setdefault(k, set()).update(got)
        spans: list[list] = [[] for _ in range(n)]
        sizes = np.diff(first)
        for k in items:
            a, b = int(first[k]), int(first[k + 1])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
            base = int(bounds[k])
            spans[k] = [{"first": int(x), "last": int(y), "start": int(starts[a + x]) - base, "stop": int(stops[a + y - 1]) - base} for x, y in zip(edge[::2], edge[1::2])]
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(row, n).cast(pa.int64()),
                pa.array(sizes.astype(np.int64)),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "spans", "items"],
        )


def scan_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (maximal hit runs: words [first, last), bytes [start, stop)), items.

    Null or wordless texts have no words and no hits; null item texts have no
    windows.  ``block`` bounds what is broadcast at a time; in a benchmark of more
    windows each block adds its hits to those of the row.  Rows are written between blocks, so a task
    holds one block at a time.
    Only the id and text columns are read; an empty benchmark gives no hits.
    """
    sc = docs.sparkSession.sparkContext
    out, last = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), None
    for found in _blocks(benchmark, window, block):
        if last is not None:
            done, out = out, staged(_add_hits(out, last), "scanned")
            discard(*[done] * ("spans" in done.columns))
        last = sc.broadcast(found)
    return _add_hits(out, last or sc.broadcast(WindowSet([], window)), text=False)


def _add_hits(rows: DataFrame, shared, text: bool = True) -> DataFrame:
    """doc_id, n_words, spans, items and ``text``, with the hits of a block added to those that ``rows`` have."""
    more = "spans" in rows.columns

    def scan(batch: pa.RecordBatch):
        at = 0
        for part in _scan(batch, shared.value):
            old = batch.slice(at, part.num_rows)
            at += part.num_rows
            if more:
                spans = [_joined(x, y) for x, y in zip(old.column("spans").to_pylist(), part.column(2).to_pylist())]
                items = [sorted({*x, *y}) for x, y in zip(old.column("items").to_pylist(), part.column(3).to_pylist())]
                part = part.set_column(2, "spans", pa.array(spans, part.schema.field(2).type)).set_column(3, "items", pa.array(items, part.schema.field(3).type))
            yield part.append_column("text", old.column("text")) if text else part

    cols = ["doc_id", "text", *["spans", "items"] * more]
    return map_arrow(rows.select(*cols), scan, SCHEMA + ", text string" * text)


def _joined(x: list[dict], y: list[dict]) -> list[dict]:
    """Two lists of runs as maximal runs: those that overlap or touch are one."""
    out: list[dict] = []
    for run in sorted(x + y, key=lambda r: (r["first"], r["last"])):
        if out and out[-1]["last"] >= run["first"]:
            out[-1] |= {k: max(out[-1][k], run[k]) for k in ("last", "stop")}
        else:
            out.append(dict(run))
    return out


def _blocks(benchmark: DataFrame, window: int, block: int):
    """WindowSets of at most ``block`` windows (or one item). Items stream to the driver, a block at a time."""
    rows, n = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        size = max(1, len(r[1]) // 2 - window)
        if rows and n + size > block:
            yield WindowSet(rows, window)
            rows, n = [], 0
        rows.append((r[0], r[1]))
        n += size
    if rows:
        yield WindowSet(rows, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, all columns; nothing is shuffled.

    Each block of the benchmark is one more filter.  Null and wordless texts stay.
    """
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    out = docs
    for found in _blocks(benchmark, window, block):
        shared = sc.broadcast(found)

        def clean(batches, shared=shared):
            for batch in batches:
                pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
                hits = [len(x) > 0 for part in _scan(pair, shared.value) for x in part.column(3).to_pylist()]
                yield batch.filter(pa.array([not x for x in hits], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def strip_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, with the bytes of every hit run cut out of the text; nothing is shuffled.

    Each block of the benchmark adds its runs to a column of the row, so all are judged on the text as it came.
    """
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    runs, kept = "_runs_" + "_".join(docs.columns), [f.name for f in docs.schema]
    out = docs.withColumn(runs, F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))
    for found in _blocks(benchmark, window, block):
        shared = sc.broadcast(found)

        def mark(batches, shared=shared):
            for batch in batches:
                pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
                more = [[{"start": x["start"], "stop": x["stop"]} for x in s] for part in _scan(pair, shared.value) for s in part.column(2).to_pylist()]
                both = [x + y for x, y in zip(batch.column(len(kept)).to_pylist(), more)]
                yield batch.set_column(len(kept), runs, pa.array(both, batch.schema.field(len(kept)).type))

        out = out.mapInArrow(mark, out.schema)

    def cut(batches):
        for batch in batches:
            texts = [t if not s else _without(t.encode(), s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist())]
            yield batch.set_column(at, kept[at], pa.array(texts, batch.schema.field(at).type)).select(kept)

    return out.mapInArrow(cut, docs.schema)


def _without(data: bytes, runs: list[dict]) -> str:
    """The text without its runs, which begin and end with words and so never inside a character."""
    out, at = [], 0
    for x in sorted(runs, key=lambda x: x["start"]):
        out.append(data[at : max(at, x["start"])])
        at = max(at, x["stop"])
    return b"".join([*out, data[at:]]).decode()


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = scan_windows(docs, benchmark)
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first)")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bwin),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT d.doc_id, d.i, d.size, b.item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.size = b.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
