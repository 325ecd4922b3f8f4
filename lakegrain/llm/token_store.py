"""Token ids in a content-addressed store.

The id stream of each document is cut into chunks where a rolling hash of the
last ids says so, so equal passages give equal chunks wherever they stand.  The
store has three tables in one folder of the shared file system:

* ``kind=chunk``   digest (SHA-256 of the payload), n_ids, payload; each digest once;
* ``kind=recipe``  the digests of each document's chunks;
* ``order``        documents in ascending doc_id order: part, place, n_tokens and the
  Merkle root over the chunk digests; ``manifest`` has one Merkle root for each part.

Reading verifies every payload against its digest, every recipe against its root
and every part against the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LibraryPieces
from .common import engine, map_arrow, release, shared_dir, small_batches, windows, working
from .kernels import mix, utf8_chunks

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids that the rolling hash sees; a cut on average every MEAN ids, never before LEAST, always after MOST.
ROLL, LEAST, MEAN, MOST = 8, 64, 512, 4096
#: Digests that a task remembers so as not to send a chunk twice; the merge drops what gets through.
REMEMBERED = 100_000
ORDER = "doc_id long, row long, n_tokens long, root binary, part int"
MANIFEST = "part int, n_docs long, n_ids long, root string"
ROWS = "kind string, key binary, doc_id long, row long, n_ids long, payload binary, digests array<binary>"


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each text of an id stream, the ends of its chunks, counted from its own start. Depends on nothing else."""
    h = windows(mix(ids.astype(np.uint64)), ROLL)
    marks = np.flatnonzero(h % np.uint64(MEAN) == 0) + ROLL
    out = []
    first = np.searchsorted(marks, bounds[:-1] + ROLL)
    last = np.searchsorted(marks, bounds[1:])
    for a, b, lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), last.tolist()):
        ends, at, n = [], 0, b - a
        for m in [*(marks[lo:hi] - a).tolist(), n]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < n:
                at = m
                ends.append(at)
        if at < n or not ends:
            ends.append(n)
        out.append(ends)
    return out


@dataclass
class Store:
    spark: SparkSession
    at: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema({"data": ROWS, "order": ORDER, "manifest": MANIFEST}[name]).parquet(f"{self.at}/{name}")


def write_store(docs: DataFrame, path: str | None = None, end_id: int = END_ID, at: str | None = None) -> Store:
    """Encodes every text (null: empty), appends ``end_id``, writes the store.

    Documents are ordered by doc_id, null ids first; rows with one id stay apart, in
    the order in which they are read.  One pass encodes; chunks reach the merge at
    most once from each task, so no digest is hot there.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    at = at or f"{shared_dir(spark)}/lakegrain/store-{uuid.uuid4().hex}"

    def run(batches):
        seen: set[bytes] = set()
        with working():
            for batch in batches:
                yield from encode(batch, seen)

    def encode(batch: pa.RecordBatch, seen: set[bytes]):
        library = engine(LibraryPieces, path)
        for row, buf, bounds in utf8_chunks(batch.column(2)):
            ids, where = library.encode_chunk(buf, bounds)
            ids = np.insert(ids, where[1:], end_id).astype("<u4")
            where = where + np.arange(len(where))
            wide = ids.max(initial=0) > 0xFFFF
            raw = None if wide else ids.astype("<u2").tobytes()
            keys, sizes, loads, roots, recipes = [], [], [], [], []
            for k, ends in enumerate(cuts(ids, where)):
                base, recipe, a = int(where[k]), [], 0
                for b in ends:
                    load = pack(ids[base + a : base + b]) if wide else b"\x02" + raw[2 * (base + a) : 2 * (base + b)]
                    digest = sha256(load).digest()
                    recipe.append(digest)
                    if digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        keys.append(digest)
                        sizes.append(b - a)
                        loads.append(load)
                    a = b
                roots.append(sha256(b"".join(recipe)).digest())
                recipes.append(recipe)
            n, m = len(keys), len(roots)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n, pa.string()), pa.array(keys, pa.binary()), none, none, pa.array(sizes, pa.int64()), pa.array(loads, pa.binary()), pa.nulls(n, pa.list_(pa.binary()))], names)
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * m), pa.array(roots, pa.binary()), batch.column(0).slice(row, m), batch.column(1).slice(row, m), pa.array(np.diff(where)), pa.nulls(m, pa.binary()), pa.array(recipes, pa.list_(pa.binary()))], names)

    names = [x.split()[0] for x in ROWS.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, ROWS)
    # chunks meet by digest, each recipe stays alone; the first of equal chunks is written
    unit = F.when(F.col("kind") == "chunk", F.col("key")).otherwise(F.col("row").cast("string").cast("binary"))
    once = rows.groupBy("kind", unit.alias("_unit")).agg(*[F.first(c).alias(c) for c in ("key", "doc_id", "row", "n_ids", "payload", "digests")])
    with small_batches(spark):
        once.drop("_unit").write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/data")
    store = Store(spark, at)
    release(spark)
    recipes = store.table("data").filter("kind = 'recipe'")
    order = recipes.select("doc_id", "row", F.col("n_ids").alias("n_tokens"), F.col("key").alias("root"))
    order.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").withColumn("part", F.spark_partition_id()).write.parquet(f"{at}/order")
    _parts(store.table("order")).write.parquet(f"{at}/manifest")
    return store


def _parts(order: DataFrame) -> DataFrame:
    """One row for each part: totals, and the root over its documents' roots in order."""
    each = F.array_sort(F.collect_list(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row", "root")))
    roots = F.transform(each, lambda x: F.hex(x["root"]))
    return order.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.sha2(F.array_join(roots, ""), 256).alias("root"))


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = b >> 1 ^ _POLY if b & 1 else b >> 1


_SHIFT: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    got = _SHIFT.get(n_bytes)
    if got is None:
        got, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                got = _times(square, got)
            square, n = _times(square, square), n >> 1
        if len(_SHIFT) < 100_000:
            _SHIFT[n_bytes] = got
    return got


def join_crc(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs and the length of the second."""
    return _times(_shift(n_bytes), first) ^ second


def pack(ids: np.ndarray) -> bytes:
    """The payload of a chunk: the bytes of an id, then the ids, little-endian."""
    return b"\x04" + ids.astype("<u4").tobytes() if len(ids) and ids.max() > 0xFFFF else b"\x02" + ids.astype("<u2").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def read_report(store: Store) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Payloads stay where they are: each is verified against its digest and gives its
    own CRC, and the CRCs of a document's chunks join to that of all its ids.
    """

    def check(batch: pa.RecordBatch):
        sizes, crcs = [], []
        for key, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if sha256(load).digest() != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            ids = unpack(load)
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    data = store.table("data")
    chunks = map_arrow(data.filter("kind = 'chunk'").select("key", "payload"), check, "digest binary, n long, crc long")
    refs = data.filter("kind = 'recipe'").select("row", F.posexplode("digests").alias("k", "digest"))
    found = refs.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc", "digest"))).alias("c"))

    def whole(batch: pa.RecordBatch):
        sizes, crcs, roots = [], [], []
        lists = batch.column(1)
        flat = lists.flatten()
        n_, crc_, digest_ = (flat.field(i).to_pylist() for i in (1, 2, 3))
        at = 0
        for k in lists.value_lengths().to_pylist():
            n, crc = n_[at], crc_[at]
            for i in range(at + 1, at + k):
                crc, n = join_crc(crc, crc_[i], 4 * n_[i]), n + n_[i]
            sizes.append(n)
            crcs.append(crc)
            roots.append(sha256(b"".join(digest_[at : at + k])).digest())
            at += k
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(roots, pa.binary())], ["row", "n", "ids_crc32", "found"])

    seen = map_arrow(found, whole, "row long, n long, ids_crc32 long, found binary")
    order = store.table("order")
    manifest = {r["part"]: (r["n_ids"], r["root"]) for r in store.table("manifest").collect()}  # one row for each part
    for r in _parts(order).collect():
        if (r["n_ids"], r["root"]) != manifest.pop(r["part"], None):
            raise ValueError(f"part {r['part']} does not agree with the manifest")
    if manifest:
        raise ValueError(f"parts {sorted(manifest)} are missing")
    totals = store.table("manifest").withColumn("_all", F.lit(0))
    before = totals.select("part", (F.sum("n_ids").over(Window.partitionBy("_all").orderBy("part")) - F.col("n_ids")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row")) - F.col("n_tokens")
    placed = order.withColumn("_in", inside).join(F.broadcast(before), "part")
    bad = F.raise_error(F.concat(F.lit("recipe differs from its root, row "), F.col("row").cast("string")))
    same = (F.col("found") == F.col("root")) & (F.col("n") == F.col("n_tokens"))
    return placed.join(seen, "row", "left").select(
        "doc_id", (F.col("before") + F.col("_in")).alias("start"), "n_tokens", F.when(same, F.col("ids_crc32")).otherwise(bad.cast("long")).alias("ids_crc32")
    )


def read_documents(store: Store) -> DataFrame:
    """doc_id, row, ids (packed little-endian uint32): the documents put together again, verified."""
    data = store.table("data")
    refs = data.filter("kind = 'recipe'").select("doc_id", "row", F.posexplode("digests").alias("k", "key"))
    parts = refs.join(data.filter("kind = 'chunk'").select("key", "payload"), "key")
    found = parts.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("k", "key", "payload"))).alias("c"))

    def build(batch: pa.RecordBatch):
        out = []
        for chunks in batch.column(2).to_pylist():
            if any(sha256(x["payload"]).digest() != x["key"] for x in chunks):
                raise ValueError("a chunk is damaged")
            out.append(b"".join(unpack(x["payload"]).tobytes() for x in chunks))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "row", "ids"])

    return map_arrow(found, build, "doc_id long, row long, ids binary")
