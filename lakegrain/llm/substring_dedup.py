"""Removal of long repeated substrings: anchors to find them, difference-cover suffix sorting as the exact reference.

The method asked for sorts all suffixes of the corpus.  :func:`suffix_array` and
:func:`repeated_windows` below do that (sort sampled triples, recurse on their names, merge in the
remaining suffixes, compare adjacent prefixes) and are what tests compare with.  On the whole corpus, suffix
records are many times the text, beyond the disk limit; so the query over whole tables narrows
the text down first, exactly as far as equal strings allow:

1. Every window of ``length`` bytes has a minimiser: the position of the smallest hash of ``GRAM`` bytes in it.
   Equal windows have equal minimisers.  Consecutive windows with one minimiser make a
   segment (about 60 windows); it is recorded with the minimiser's hash and a hash of all its bytes.
2. A segment whose minimiser occurs once repeats nowhere.  A segment that occurs as a whole
   elsewhere repeats in every window.  Both are decided by counts, summed before each shuffle.
3. What is left (the ends of copied passages) is compared in blocks of 8 windows, by the bytes that all eight share
   and by all their bytes, and only where those disagree window by window; all by counts.

Nothing is sampled or capped: hashes only decide where equal bytes can be, and a window counts
as repeated when 128 bits (minimiser and window) agree.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, release, staged
from .kernels import mix, span_hashes, utf8_chunks

LENGTH, GRAM = 200, 64
#: Windows that are first compared together.
BLOCK = 8
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64)
_STEPS = _RNG.integers(1, 1 << 63, 10, np.uint64) | np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SEGMENT = pa.struct([("mh", pa.int64()), ("sh", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def gram_hashes(buf: np.ndarray, levels: int) -> list[np.ndarray]:
    """Hashes of every 1, 2, 4, .. 2**levels bytes."""
    h = _BYTE[buf]
    out = [h]
    for k in range(levels):
        step = 1 << k
        g = h[:-step] * _STEPS[k] if len(h) > step else h[:0].copy()
        if len(g):
            g += h[step:]
        out.append(h := g)
    return out


def window_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` bytes, put together from powers of two."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    levels = gram_hashes(buf, length.bit_length() - 1)
    out, at = np.zeros(n, np.uint64), 0
    for k in range(length.bit_length() - 1, -1, -1):
        if length >> k & 1:
            out = out * _STEPS[9] + levels[k][at : at + n]
            out ^= out >> np.uint64(31)
            at += 1 << k
    return mix(out)


def segments(buf: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM):
    """(minimiser hash, hash of the bytes, text, start in the text, windows) of every segment."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(buf) < length:
        return none
    h = mix(gram_hashes(buf, gram.bit_length() - 1)[-1])
    low = h & _HIGH | np.arange(len(h), dtype=np.uint64)
    places, k = length - gram + 1, 1
    while 2 * k <= places:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if places > k:
        low = np.minimum(low[: k - places], low[places - k :])
    n = len(low)
    a, b = bounds[:-1], bounds[1:]
    fits = b - a >= length
    depth = np.bincount(a[fits], minlength=n + 1) - np.bincount(b[fits] - length + 1, minlength=n + 1)[: n + 1]
    inside = np.cumsum(depth)[:n] > 0
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    new[a[fits]] = True
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    if not len(start):
        return none
    mh = h[(low[start] & _LOW).astype(np.int64)]
    sh = span_hashes(buf, start, stop + length - 1, 1, 64)[0]
    text = np.searchsorted(bounds, start, "right") - 1
    return mh, sh, text, start - bounds[text], stop - start


def _print(data: memoryview) -> bytes:
    return blake2b(data, digest_size=16).digest()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when some string of ``length`` bytes that covers it also starts anywhere else, in any row; a
    row written twice repeats itself.  Texts are bytes of UTF-8, null is empty, strings do not
    cross texts and are judged on the input.  Texts shorter than ``length`` stay.  Null and
    repeated ids are rows like others; only id and text are read.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("node"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batch: pa.RecordBatch):
        for row, buf, bounds in utf8_chunks(batch.column(2)):
            n = len(bounds) - 1
            mh, sh, text, start, size = segments(buf, bounds, length)
            data = memoryview(buf.tobytes())
            each = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            found = pa.StructArray.from_arrays([pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(start), pa.array(size.astype(np.int32))], fields=list(SEGMENT))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(bounds)), pa.array([sha256(x).hexdigest() for x in each], pa.string()), pa.array(map(_print, each), pa.binary()), lists],
                ["doc_id", "node", "n_bytes", "sha", "print", "segments"],
            )

    scan = staged(map_arrow(rows, cut, "doc_id long, node long, n_bytes long, sha string, print binary, segments array<struct<mh:long,sh:long,start:long,n:int>>"), "segments")
    segs = scan.select("node", F.inline("segments"))
    # counts are written before they are joined, so that Spark can split the join of a hot key
    often = staged(segs.groupBy("mh").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("mh"), "often")
    release(spark)
    again = staged(segs.join(often, "mh"), "again")
    about = staged(scan.drop("segments"), "about")
    discard(scan, often)
    release(spark)
    same = staged(again.groupBy("mh", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "start", "n")).alias("one")), "same")
    release(spark)
    kinds = same.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("c") == 1).cast("int")).alias("single"))
    whole = again.join(same.filter("c > 1").select("mh", "sh"), ["mh", "sh"]).select("node", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    whole = staged(whole, "whole")
    release(spark)
    # segments that share a minimiser only: one of each kind, cut to windows
    part = same.join(kinds.filter("kinds > 1 and single > 0").select("mh"), "mh").select("one.node", F.struct("one.start", "one.n", "mh").alias("s"))
    part = staged(part.groupBy("node").agg(F.collect_list("s").alias("parts")), "parts")
    discard(again, same)
    release(spark)
    known = about.select(F.col("doc_id").alias("_id"), "node", "print")

    def with_text(some: DataFrame) -> DataFrame:
        return some.join(known, "node").join(rows.select("doc_id", "text"), F.col("doc_id").eqNullSafe(F.col("_id")))

    def cut_blocks(batch: pa.RecordBatch):
        done = set()
        for row, buf, bounds in utf8_chunks(batch.column(0)):
            grams = mix(gram_hashes(buf, GRAM.bit_length() - 1)[-1])
            inner, h = window_hashes(buf, length - BLOCK + 1), window_hashes(buf, length)
            nodes, prints, parts = (batch.column(i).slice(row, len(bounds) - 1).to_pylist() for i in (1, 2, 3))
            found: list[tuple[int, int, int, int, int]] = []  # start and windows in the chunk, minimiser's place and hash, text
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                if nodes[k] in done or _print(memoryview(buf[a:b].tobytes())) != prints[k]:
                    continue
                done.add(nodes[k])
                for x in parts[k]:
                    first = a + x["start"]
                    low = first + x["n"] - 1
                    near = grams[low : first + length - GRAM + 1] == np.uint64(x["mh"] & 0xFFFFFFFFFFFFFFFF)
                    found.append((first, x["n"], low + int(near.argmax()), x["mh"], k))
            if not found:
                continue
            first, n, place, mh, text = (np.array(x, np.int64) for x in zip(*found))
            seg = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[seg]
            group = (place[seg] - at) // BLOCK
            new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (group[1:] != group[:-1])])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(at)) - 1
            of, g = seg[lo], group[lo]
            seed = mix(mh.view(np.uint64))
            keys = mix(h[at] ^ seed[seg])
            core = mix(inner[place[of] - g * BLOCK] ^ mix(seed[of] + g.astype(np.uint64)))
            full = mix(keys[lo] * _STEPS[8] + keys[hi] + (hi - lo).astype(np.uint64))
            node = np.array(nodes, np.int64)[text[of]]
            start = at[lo] - bounds[text[of]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(lo, len(at)).astype(np.int32)), pa.array(keys.view(np.int64)))
            table = pa.Table.from_arrays([pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(node), pa.array(start), lists], ["core", "full", "node", "start", "keys"])
            yield from table.to_batches(max_chunksize=50_000)

    cells = staged(map_arrow(with_text(part).select("text", "node", "print", "parts"), cut_blocks, "core long, full long, node long, start long, keys array<long>"), "blocks")
    release(spark)
    alike = cells.groupBy("core", "full").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "start")).alias("one"))
    mixed = alike.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core")
    block = cells.select("core", "full", "node", "start", F.size("keys").alias("n")).join(alike.filter("c > 1").select("core", "full"), ["core", "full"])
    block = block.select("node", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    # blocks that share their inner bytes only: one of each kind, window by window
    ones = staged(alike.join(mixed, "core").select("one.node", "one.start"), "ones")
    single = cells.select("node", "start", "keys").join(ones, ["node", "start"]).select("node", "start", F.posexplode("keys").alias("i", "key"))
    single = staged(single.select("key", "node", (F.col("start") + F.col("i")).alias("start")), "windows")
    release(spark)
    twice = single.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    last = single.join(twice, "key").select("node", "start", (F.col("start") + length).alias("stop"))
    spans = whole.unionByName(block).unionByName(last).groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = staged(spans, "spans")
    discard(cells, single, whole)
    release(spark)

    def drop(batch: pa.RecordBatch):
        out: list[list] = [[], [], [], [], [], []]
        for text, node, known_print, spans, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            if _print(memoryview(data)) != known_print:
                continue
            kept, at, runs, removed = sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for x in sorted((s["start"], s["stop"]) for s in spans):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            for a, b in merged:
                kept.update(data[at:a])
                at, runs, removed = b, runs + 1, removed + b - a
            kept.update(data[at:])
            for x, y in zip(out, (doc_id, node, len(data), removed, runs, kept.hexdigest())):
                x.append(y)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.string())], ["doc_id", "node", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    hit = map_arrow(with_text(spans).select("text", "node", "print", "spans", "_id"), drop, "doc_id long, node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    hit = hit.dropDuplicates(["node"])  # a row written twice meets its text twice
    rest = about.join(spans.select("node"), "node", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return hit.drop("node").unionByName(rest)


def _rank(keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Names 1.. of equal rows in sorted order, and whether all differ."""
    order = np.lexsort(keys.T[::-1])
    rows = keys[order]
    name = np.concatenate([[1], 1 + np.cumsum((rows[1:] != rows[:-1]).any(1))])
    out = np.empty(len(keys), np.int64)
    out[order] = name
    return out, name[-1] == len(keys)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by the difference cover {1, 2} modulo 3."""
    s, n = s.astype(np.int64) + 1, len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    name, distinct = _rank(np.stack([t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)]], 1))
    if distinct:
        order = np.argsort(name)
    else:
        order = suffix_array(np.concatenate([name, [0]]))
        order = order[order < len(name)]
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    sampled = sampled[sampled < n]
    out, i, j = np.empty(n, np.int64), 0, 0
    for k in range(n):  # merge: one or two letters, then ranks of the sample
        if i == len(sampled):
            out[k:] = zero[j:]
            break
        if j == len(zero):
            out[k:] = sampled[i:]
            break
        a, b = sampled[i], zero[j]
        if a % 3 == 1:
            less = (t[a], rank[a + 1]) < (t[b], rank[b + 1])
        else:
            less = (t[a], t[a + 1], rank[a + 2]) < (t[b], t[b + 1], rank[b + 2])
        out[k] = a if less else b
        i, j = i + less, j + (not less)
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which starts have a window of ``length`` bytes that starts elsewhere too: by the suffix array."""
    sizes = [len(t) for t in texts]
    s = np.concatenate([np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), [k]]) for k, t in enumerate(texts)]) if texts else np.zeros(0, np.int64)
    order = suffix_array(s)
    hit = np.zeros(len(s), bool)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        if max(a, b) + length <= len(s) and np.array_equal(s[a : a + length], s[b : b + length]):
            hit[a] = hit[b] = True  # separators differ, so equal windows hold none
    at = np.cumsum([0, *(n + 1 for n in sizes)])
    return [hit[a : a + n] for a, n in zip(at, sizes)]


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
l AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM l WHERE n >= 200)),
r AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS run
      FROM (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, true) AS new FROM r)),
u AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM u),
k AS (SELECT v.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(x, 2 * m + 1)) AS kept
      FROM v JOIN l USING (doc_id) JOIN (SELECT doc_id, max(b) AS m FROM u GROUP BY doc_id) USING (doc_id) GROUP BY v.doc_id)
SELECT l.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM l LEFT JOIN k USING (doc_id)
"""
