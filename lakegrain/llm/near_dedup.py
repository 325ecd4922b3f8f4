"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

1. A text's word shingles are hashed and sorted; the sorted set is its own
   one-permutation sketch (the first value in each of BINS equal ranges).  An empty
   bin takes the value of the first filled bin in a random order of its own.
2. Texts with one set of shingles form a class; one row stands for it from here on.
3. Bands of the sketch deal classes to buckets.  In a bucket edges go from the centre, its first class, to the
   members, never from all to all.  Edges are confirmed on the full sets, and components are formed.
4. A bucket whose members are in one component is done.  Of the others, texts go that share too few shingles with
   all other undecided texts together to be alike any of them: a count, linear in the shingles.
5. What is left in a bucket is compared across components by exact bounds (sizes, shared shingles, and the parity
   bitmap of the set, which gives each pair a least difference) inside the join, so a pair that cannot be alike is
   never a row.  The few that pass are confirmed on the full sets.  No link that a bucket shows is lost.

A key with many rows (a bucket, a component, a class, the centre of a large star) is met by sums before the
shuffle, by salts, or by sort-merge joins whose heavy partitions Spark splits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, chunk_words, discard, map_arrow, numbered, release, staged, windows, without_rows
from .kernels import mix

SHINGLE, PERCENT = 5, 85
#: Sketch values. With ``rows`` of them in a band a pair of similarity s shares a band with 1 - (1 - s**rows)**(BINS / rows).
BINS = 192
#: Share of the pairs at the threshold itself that banding may miss; less above it. 3e-7 are missed at 0.85, 6e-5 at 0.8.
MISSED = 1e-4
WORD = byte_class(r"[^\x20\x09-\x0D]")
#: Rows (60 bytes each at most; bitmaps 160) of a staged table that are broadcast rather than joined by sorting.
BROADCAST_ROWS = 200_000
#: Files of tables that small.
FILES = 6
#: Runs that the edges of one centre are dealt to.
RUNS = 256
#: Words of 64 bits in the bitmap of an undecided text.
WORDS = 16
_RNG = np.random.default_rng(3)
_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], dtype=object).astype(np.uint64)
_ORDER = np.argsort(_RNG.random((BINS, BINS)), axis=1)


def band_rows(percent: int) -> int:
    """Sketch values in a band: as many as miss no more than MISSED of the pairs at the threshold."""
    s = percent / 100
    for rows in (6, 4, 3, 2, 1):
        if (1 - s**rows) ** (BINS // rows) <= MISSED:
            return rows
    raise ValueError(f"{percent} percent is too low a similarity for {BINS} sketch values")


def shingle_sets(column: pa.Array):
    """For each text in turn its sorted distinct shingle hashes (uint64)."""
    for _, n, low, starts, stops, first, hashes, _ in chunk_words(column, WORD):
        h = mix(windows(hashes, SHINGLE))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                s = np.sort(h[a : b - SHINGLE + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield mix(windows(hashes[a:b], b - a) ^ np.uint64(b - a))
            else:
                yield h[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """BINS values of a sorted, not empty set."""
    at = np.searchsorted(s, _EDGES)
    values = s[np.minimum(at, len(s) - 1)]
    full = np.zeros(BINS, bool)
    full[:-1] = (at[:-1] < len(s)) & (values[:-1] < _EDGES[1:])
    full[-1] = at[-1] < len(s)
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(1)]]
    return values


def bands(s: np.ndarray, rows: int) -> np.ndarray:
    v = mix(sketch(s)).reshape(-1, rows)
    out = np.arange(len(v), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + v[:, i])
    return out.view(np.int64)


def _print(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(batch: pa.RecordBatch):
    """Sets of candidate rows; a row that only shares id and hash with a candidate has another print and gives none."""
    keep, sets = [], []
    for s, known in zip(shingle_sets(batch.column(0)), batch.column(2).to_pylist()):
        keep.append(len(s) > 0 and _print(s) == known)
        sets.append(s.tobytes())
    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["node", "set"]).filter(pa.array(keep, pa.bool_()))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets.
    ``component_id`` is the smallest doc_id that links reach.  Null, empty and blank texts have no
    shingles and are linked with nothing.  A null doc_id never names a component; a component of null ids
    only has a null component_id and is kept.  Rows with one id and one text are both returned with the same result.
    Only id and text are read, whatever other columns there are.
    """
    out = _judged(docs, None, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component of texts that are ``percent`` alike; all columns.

    Rows go by their number, so copies under one id or without an id go too, and other texts of such an id stay.
    """
    rows, name = numbered(docs)
    gone = _judged(rows, name, percent).filter("node <> head")
    return without_rows(rows, name, gone.select(F.col("node").alias(name)))


def _judged(docs: DataFrame, number: str | None, percent: int) -> DataFrame:
    """node, doc_id, n_shingles, component_id, and ``head``, the node of the one row that stands for the component.

    ``number`` is a column that numbers the rows; without one they are numbered as they are read, and found again
    by id and text hash.
    """
    sig = staged(_signatures(docs, number, percent), "signatures")
    classed = _classes(sig)
    discard(sig)
    active = _shared_buckets(classed)
    release(docs.sparkSession)
    fits = f"100 * least(n, other) >= {percent} * greatest(n, other)"
    edges = _kept(active.filter("node <> low").filter(fits).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "edges", active)
    sets = _sets_of(docs, number, classed, active)
    links = _confirmed(edges, sets, percent)
    labels = connected(links)
    live = _undecided(active, labels)
    more = _confirmed(_kept(_alike(_bounded(live, sets, percent), percent), "edges", live), sets, percent)
    if not more.isEmpty():
        labels = connected(_union(links, more), labels)
    discard(active, sets, live)
    release(docs.sparkSession)
    return _named(classed, labels)


def _rows(df: DataFrame) -> int:
    """Rows of a staged table, counted once."""
    if not hasattr(df, "_rows"):
        df._rows = df.count()
    return df._rows


def _light(df: DataFrame) -> DataFrame:
    """A staged table for a join: broadcast up to BROADCAST_ROWS rows, else joined by sorting, where Spark splits heavy keys."""
    return F.broadcast(df) if _rows(df) <= BROADCAST_ROWS else df.hint("merge")


def _kept(df: DataFrame, label: str, bound: DataFrame) -> DataFrame:
    """``staged``, in a few files if the table ``bound``, from whose rows it is made, is small."""
    return staged(df.coalesce(FILES) if _rows(bound) <= BROADCAST_ROWS else df, label)


def _signatures(docs: DataFrame, number: str | None, percent: int) -> DataFrame:
    """doc_id, node, t (hash of the text), n (shingles), print (of the set), bands."""
    rows = band_rows(percent)

    def each(batch: pa.RecordBatch):
        n, prints, flat, ends = [], [], [], [0]
        for s in shingle_sets(batch.column(3)):
            n.append(len(s))
            prints.append(_print(s))
            if len(s):
                flat.append(bands(s, rows))
            ends.append(ends[-1] + (BINS // rows if len(s) else 0))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), keys], ["doc_id", "node", "t", "n", "print", "bands"])

    node = F.col(number) if number else F.monotonically_increasing_id()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), F.xxhash64("text").alias("t"), "text")
    return map_arrow(texts, each, "doc_id long, node long, t long, n long, print binary, bands array<long>")


def _classes(sig: DataFrame) -> DataFrame:
    """doc_id, node, t, n, print, rep, first, bands: ``rep`` is the row of the class with the smallest id, ``first``.

    Only rows that stand for a class keep their bands.  Rows without shingles are classes of their own.
    """
    best = F.struct(F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("id"), (-F.col("node")).alias("node"))
    copies = sig.filter("n > 0").groupBy("print").agg(F.max(best).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    copies = staged(copies.select("print", (-F.col("m.node")).alias("_rep"), (-F.col("m.id")).alias("_first")), "copies")
    rows = sig.join(_light(copies), "print", "left")
    rows = rows.withColumns({"rep": F.coalesce("_rep", "node"), "first": F.when(F.col("_rep").isNull(), F.col("doc_id")).otherwise(F.col("_first"))})
    rows = rows.withColumn("bands", F.when((F.col("node") == F.col("rep")) & (F.col("n") > 0), F.col("bands")))
    return staged(rows.select("doc_id", "node", "t", "n", "print", "rep", "first", "bands"), "classes")


def _shared_buckets(classed: DataFrame) -> DataFrame:
    """(key, node, n, low, other) of buckets with two classes or more; the centre is ``low`` and has ``other`` shingles."""
    buckets = classed.filter("bands is not null").select("node", "n", F.explode("bands").alias("key"))
    ends = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("_low"), F.max("node").alias("_high")).filter("_low.node < _high")
    centres = staged(ends.select("key", F.col("_low.node").alias("low"), F.col("_low.n").alias("other")), "centres")
    return staged(buckets.join(_light(centres), "key"), "buckets")


def _sets_of(docs: DataFrame, number: str | None, classed: DataFrame, active: DataFrame) -> DataFrame:
    """(node, set): the full sets of the classes in ``active``, from a second scan of the texts."""
    nodes = _light(_kept(active.select("node").distinct(), "nodes", active))
    wanted = staged(classed.filter("node = rep").join(nodes, "node").select("doc_id", "node", "t", "print"), "wanted")
    few = _light(wanted)
    if number:
        wide = docs.select(F.col(number).alias("node"), "text").join(few.drop("doc_id"), "node")
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"), "text")
        wide = texts.join(few, (F.col("_t") == F.col("t")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    sets = staged(map_arrow(wide.select("text", "node", "print"), _sets, "node long, set binary"), "sets")
    if sets.count() > wanted.count():  # rows with one id and one text gave a set each
        sets = staged(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    return sets


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are alike enough.

    The edges of ``a`` are dealt to RUNS runs.  The set of ``a`` comes first in a run and only once, then those of its
    partners one by one, so a worker holds two sets and a batch, however large the star is.
    """
    dealt = edges.withColumn("run", F.pmod(F.xxhash64("b"), F.lit(RUNS)).cast("int"))
    dealt._rows = _rows(edges)
    first = _kept(dealt.select("a", "run").distinct(), "centres", edges)
    centres = sets.withColumnRenamed("node", "a").join(_light(first), "a").select("a", "run", F.lit(None).cast("long").alias("b"), "set")
    members = sets.withColumnRenamed("node", "b").join(_light(dealt), "b").select("a", "run", "b", "set")
    runs = centres.unionByName(members).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def check(batches):
        centre = None
        for batch in batches:
            mine, theirs = [], []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    centre = s.copy()
                    continue
                both = np.concatenate([centre, s])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    mine.append(a)
                    theirs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(theirs, pa.int64())], ["a", "b"])

    return staged(runs.select("a", "b", "set").mapInArrow(check, "a long, b long"), "links")


def _union(x: DataFrame, y: DataFrame) -> DataFrame:
    out = x.unionByName(y)
    out._rows = _rows(x) + _rows(y)
    return out


def connected(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node with a link: the smallest node that links reach.

    Labels spread to neighbours and jump to the label of their label until nothing changes.  ``known`` has labels
    from a part of the links to start from.
    """
    both = _kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both", links)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    if known is not None:
        labels = labels.join(_light(known.withColumnRenamed("label", "_old")), "node", "left").select("node", F.least("label", "_old").alias("label"))
    labels = _kept(labels, "labels", both)
    while True:
        light = _light(labels)
        heard = both.join(light.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        heard = heard.unionByName(labels.select("node", "label", F.col("label").alias("old")))
        spread = heard.groupBy("node").agg(F.min("label").alias("to"), F.max("old").alias("old"))
        jumped = spread.join(light.select(F.col("node").alias("to"), F.col("label").alias("far")), "to")
        new = _kept(jumped.select("node", "old", F.least("to", "far").alias("label")), "labels", both)
        discard(labels)
        if new.filter("old <> label").isEmpty():
            discard(both)
            return new.select("node", "label")
        labels, labels._staged_at = new.select("node", "label"), new._staged_at


def _undecided(active: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, low, label) of buckets whose members are in more than one component."""
    now = active.join(_light(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = now.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y")
    return staged(now.join(_light(_kept(open_.select("key"), "open", active)), "key").select("key", "node", "n", "low", "label"), "undecided")


def _bounded(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``live`` with (c, bits) of the texts that can have a link.

    ``c`` counts the shingles that some other undecided text has too: the intersection with any of these is at most
    c, and the union at least the text's own size.  ``bits`` is the parity bitmap of the set.
    """
    nodes = _kept(live.select("node", "n").distinct(), "nodes", live)

    def each(batch: pa.RecordBatch):
        for node, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = np.frombuffer(s.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), node, np.int64))], ["h", "node"])

    shingles = map_arrow(sets.join(_light(nodes), "node", "left_semi"), each, "h long, node long")
    alone = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    alone = _kept(alone.groupBy("node").agg(F.count(F.lit(1)).alias("u")), "alone", nodes)
    sizes = nodes.join(_light(alone), "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
    sizes = staged(sizes.filter(f"100 * c >= {percent} * n").select("node", "c"), "sizes")
    bits = staged(map_arrow(sets.join(_light(sizes), "node").select("node", "set", "c"), _bitmaps, "node long, c long, bits array<long>"), "bitmaps")
    discard(nodes, alone, sizes)
    return live.join(_light(bits), "node")


def _bitmaps(batch: pa.RecordBatch):
    """Each shingle flips one of 64 * WORDS bits, so two bitmaps differ in no more bits than their sets do in shingles."""
    flat = []
    for s in batch.column(1):
        place = np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(64 * WORDS)
        odd = np.bincount(place.astype(np.int64), minlength=64 * WORDS) & 1
        flat.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    flat = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * WORDS), flat)
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["node", "c", "bits"])


def _alike(live: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components of a bucket that no bound rules out; those with the centre were confirmed before."""
    names = {c: c + "2" for c in ("node", "n", "c", "bits", "label")}
    other = live.select(F.col("key").alias("key2"), *[F.col(a).alias(b) for a, b in names.items()])
    differ = " + ".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(WORDS))
    bound = f"100 * least(c, c2) >= {percent} * (n + n2 - least(c, c2)) and {100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"
    pairs = live.join(other.hint("merge"), F.expr(f"key = key2 and node < node2 and label <> label2 and node <> low and {bound}"))
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _named(classed: DataFrame, labels: DataFrame) -> DataFrame:
    """What ``_judged`` returns, from the labels of classes with a link."""
    best = F.struct(F.col("first").isNotNull().alias("has"), (-F.col("first")).alias("id"), (-F.col("node")).alias("node"))
    light = _light(labels)
    reps = classed.filter("node = rep").select("node", "first").join(light, "node")
    names = _kept(reps.groupBy("label").agg(F.min("first").alias("component_id"), F.max(best).alias("_m")), "names", labels)
    component = labels.join(_light(names), "label").select(F.col("node").alias("rep"), "component_id", (-F.col("_m.node")).alias("head"))
    rows = classed.select("node", "doc_id", "n", "rep", "first").join(_light(staged(component, "components")), "rep", "left")
    linked = F.col("head").isNotNull()
    return rows.select(
        "node", "doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
        F.when(linked, F.col("head")).otherwise(F.col("rep")).alias("head"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
