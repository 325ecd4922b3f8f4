"""What the operators of this subpackage share: tables, staging, keyed merges, text kernels."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import span_hashes, utf8_chunks

#: Rows of one key are first merged in so many salted runs.
SALTS, FAN = 64, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a folder of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_lakegrain_shared", None)
        if not found:
            found = spark._lakegrain_shared = "file://" + tempfile.mkdtemp(prefix="lakegrain-")
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch while a table is staged: what one task holds of its input, however long the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside send workers batches of BATCH_ROWS rows or BATCH_BYTES bytes, whichever is less."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    old = [spark.conf.get(k) for k in names]
    for k, v in zip(names, (BATCH_ROWS, BATCH_BYTES)):
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in zip(names, old):
            spark.conf.set(k, v)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lakegrain/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables made by ``staged`` that no later step reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def salt(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def tree_merge(rows: DataFrame, keys: list[str], best: Column, name: str, rounds: int = 2) -> DataFrame:
    """For each row (with column ``_salt``), the greatest ``best`` and the number of rows of its keys.

    The rows of a key meet in runs: one for each key and salt, then one for each
    ``FAN`` of those, and so on, and last one for the key.  Each round sums before
    it shuffles, so a key that holds a third of all rows reaches no task with more
    than a few rows from each task before.  The answer goes down the same tree, so
    no join has more than 1/SALTS of a hot key's rows on one key.
    """
    levels = [rows.groupBy(*keys, "_salt").agg(F.max(best).alias(name), F.count(F.lit(1)).alias("_n"))]
    for k in range(1, rounds):
        up = F.floor(F.col("_salt") / FAN).cast("int") if k < rounds - 1 else F.floor(F.col("_salt") / FAN**k).cast("int")
        levels.append(levels[-1].withColumn("_salt", up).groupBy(*keys, "_salt").agg(F.max(name).alias(name), F.sum("_n").alias("_n")))
    top = levels[-1].groupBy(*keys).agg(F.max(name).alias(name), F.sum("_n").alias("_n"))
    down = levels[-1].select(*keys, "_salt").join(top, keys)
    for level in levels[-2::-1]:
        down = level.select(*keys, "_salt", F.floor(F.col("_salt") / FAN).cast("int").alias("_up")).join(down.withColumnRenamed("_salt", "_up"), [*keys, "_up"]).drop("_up")
    return rows.join(down, [*keys, "_salt"])


#: Row numbers that are broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A staged copy of ``docs`` with a number of its own for each row, and the column's name, which ``docs`` doesn't have."""
    name = "_row_" + "_".join(docs.columns)
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without_rows(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose number is not in the column ``name`` of ``gone``, without the number."""
    gone = staged(gone.select(name), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, name, "left_anti").drop(name)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes a class of single characters takes; every byte from 0x80 on goes with character 0x80."""
    one = re.compile(pattern)
    return np.array([bool(one.fullmatch(chr(min(b, 0x80)))) for b in range(256)])


def words(buf: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cases A-Z; (bytes, word starts, word stops, first word of each text and the end). Words end with their text."""
    low = _LOWER[buf]
    mask = is_word[low]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], mask[:-1]]) if len(buf) else mask
    after = np.concatenate([mask[1:], [False]]) if len(buf) else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    stops = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return low, starts, stops, np.searchsorted(starts, bounds)


_STEP = 0x9FB21C651E98DF25


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values: a polynomial of them, put together from those of 1, 2, 4, ... values."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    power, width, out, size = hashes, 1, None, 0
    while True:
        factor = np.uint64(pow(_STEP, width, 1 << 64))
        if k & width:
            out = power if out is None else out[:-width] * factor + power[size:]
            size += width
        if 2 * width > k:
            break
        power = power[:-width] * factor + power[width:]
        width *= 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def chunk_words(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple]:
    """(first row, number of rows, bytes, starts, stops, first word of each text, word hashes, bounds) of chunks of a column."""
    for row, buf, bounds in utf8_chunks(column):
        low, starts, stops, first = words(buf, bounds, is_word)
        yield row, len(bounds) - 1, low, starts, stops, first, span_hashes(low, starts, stops, 1)[0], bounds


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        with working():
            for batch in batches:
                yield from kernel(batch)

    return df.mapInArrow(run, schema)


_ENGINES: dict[tuple, object] = {}
#: Kinds of engines that the task has asked for.
_ASKED: set[type] = set()
#: Tasks that run in this worker (two if one feeds the other), and how many have begun.
_TASKS, _LOCK = [0, 0], threading.Lock()
#: Seconds that an idle worker keeps its engines: the next task of a stage comes sooner.
IDLE_S = 1.0


@contextmanager
def working() -> Iterator[None]:
    """Around what a task does in a worker: engines that the worker's last task did not ask for go, and all go once it is idle."""
    with _LOCK:
        if not _TASKS[0]:
            forget_engines()
        _TASKS[0] += 1
        _TASKS[1] += 1
    try:
        yield
    finally:
        with _LOCK:
            _TASKS[0] -= 1
        if _ENGINES:
            timer = threading.Timer(IDLE_S, _rest, [_TASKS[1]])
            timer.daemon = True
            timer.start()


def _rest(begun: int) -> None:
    """Gives an idle worker's memory back, for the stages of others that follow."""
    import ctypes
    import gc

    with _LOCK:
        if _TASKS != [0, begun]:
            return
        _ENGINES.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def forget_engines() -> None:
    """At the start of a task: drops the engines that the worker's last task did not ask for, so stages do not add up in memory."""
    for key in [k for k in _ENGINES if k[0] not in _ASKED]:
        del _ENGINES[key]
    _ASKED.clear()


def engine(kind: type, *args):
    """One engine of its kind and arguments for each Python worker; its caches live until a stage asks for other things."""
    _ASKED.add(kind)
    if (kind, args) not in _ENGINES:
        _ENGINES[kind, args] = kind(*args)
    return _ENGINES[kind, args]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now rather than at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
