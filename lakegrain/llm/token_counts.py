"""Token counts of documents in flat token files without an index.

A flat file holds ids end to end, each document followed by the end-of-document
id.  Files are read in blocks of equal size, far apart from each other; each
block is searched for the end id in one vectorised comparison.  What a block
cannot know (how many documents ended before it, how much of its first document
lies in earlier blocks) comes from a prefix scan over one small row per block.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LibraryPieces
from .common import engine, shared_dir, staged, working
from .kernels import utf8_chunks

TOKENIZER, END_OF_DOCUMENT, WIDTH = "byte_bpe_50k.json", 50256, 2
#: Bytes of a block.
BLOCK = 4 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_flat(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END_OF_DOCUMENT, width: int = WIDTH) -> tuple[str, DataFrame]:
    """Writes one flat file for each partition of ``docs``; returns the folder and (doc_id, file, place, bytes).

    Nulls and empty texts become documents of no tokens.  The end id never comes
    from a text: strings of special tokens are encoded as ordinary text.  A file is
    written under a name of its own and then renamed, so a task that runs twice leaves one file.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    folder = folder or f"{shared_dir(spark)}/lakegrain/flat-{uuid.uuid4().hex}"

    def run(batches):
        with working():
            yield from encode(batches)

    def encode(batches):
        library, fs, base = None, *_fs(folder)
        task = TaskContext.get()
        name, part = f"{base}/{task.partitionId():06d}.bin", task.partitionId()
        fs.create_dir(base, recursive=True)
        place, size, rows = 0, 0, []
        with fs.open_output_stream(own := f"{name}.{task.taskAttemptId()}") as out:
            for batch in batches:
                library = library or engine(LibraryPieces, path, True)
                for row, buf, bounds in utf8_chunks(batch.column(1)):
                    ids, at = library.encode_chunk(buf, bounds)
                    ids = np.insert(ids, at[1:], end)
                    if ids.max(initial=0) >= 1 << 8 * width:
                        raise ValueError(f"ids need more than {width} bytes")
                    n = len(bounds) - 1
                    out.write(ids.astype(f"<u{width}").tobytes())
                    rows.append((batch.column(0).slice(row, n), place, n))
                    place, size = place + n, size + width * len(ids)
        fs.move(own, name)
        for ids, at, n in rows:
            yield pa.RecordBatch.from_arrays([ids, pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n)), pa.array([size] * n, pa.int64())], ["doc_id", "file", "place", "bytes"])

    return folder, staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, file int, place long, bytes long"), "flat-rows")


def count_flat(spark: SparkSession, files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, place, n_tokens) of every document in the files; ``files`` has file (number) and bytes.

    Documents may span any number of blocks.  Ids after the last end id of a file are
    a document that was cut off; they are not counted.  Empty files have no documents.
    """
    if block % width:
        raise ValueError("a block holds whole ids")
    blocks = files.filter(F.col("bytes") > 0).select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"))

    def search(batches):
        fs, base = _fs(folder)
        for batch in batches:
            for file, size, k in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{base}/{file:06d}.bin") as f:
                    ids = np.frombuffer(f.read_at(min(block, size - k * block), k * block), f"<u{width}")
                ends = np.flatnonzero(ids == end)
                lens = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([tail], pa.int64()), pa.array([lens], pa.list_(pa.int64()))], ["file", "block", "n_ends", "tail", "lens"])

    found = blocks.repartition("file", "block").mapInArrow(search, "file int, block long, n_ends long, tail long, lens array<long>")
    found = staged(found, "flat-blocks")
    # prefix scan over one small row for each block; the lengths stay behind
    w = Window.partitionBy("file").orderBy("block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", "n_ends", "tail").withColumn("_before", F.coalesce(F.sum("tail").over(past), F.lit(0)))
    scan = scan.withColumn("_mark", F.coalesce(F.last(F.when(F.col("n_ends") > 0, F.col("_before")), ignorenulls=True).over(past), F.lit(0)))
    scan = scan.select("file", "block", F.coalesce(F.sum("n_ends").over(past), F.lit(0)).alias("_first"), (F.col("_before") - F.col("_mark")).alias("_carry"))
    each = found.filter(F.col("n_ends") > 0).join(scan, ["file", "block"]).select("file", "_first", "_carry", F.posexplode("lens").alias("_k", "_len"))
    return each.select("file", (F.col("_first") + F.col("_k")).alias("place"), (F.col("_len") + F.when(F.col("_k") == 0, F.col("_carry")).otherwise(0)).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, file, place, n_tokens (end id not counted) of every row of ``docs``, by way of flat files."""
    folder, rows = write_flat(docs, path=path)
    files = rows.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counts = count_flat(docs.sparkSession, files, folder)
    return rows.select("doc_id", "file", "place").join(counts, ["file", "place"], "left").select("doc_id", "file", "place", "n_tokens")
