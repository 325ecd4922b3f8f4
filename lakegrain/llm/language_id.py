"""Language ID by language-bitmask n-gram filters.

The filters of all languages lie bit-sliced in one array: bit l of a slot belongs
to language l.  An n-gram reads its slots once and the conjunction has a bit for
every language that contains it.  A text's hits are counted for each bit,
corrected for the filters' false positives, and the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, working
from .kernels import mix, utf8_chunks

#: Bytes of an n-gram; documents of each language that the filters are fitted on (about); share of them that must
#: have an n-gram; share of the highest rate of any language that its rate must reach; slots and probes of the filters.
GRAM, FIT_DOCS, MIN_SHARE, MIN_RATIO, SLOTS, PROBES = 4, 2000, 0.004, 0.2, 1 << 20, 2
#: Labels that are learned; beyond, ``fit`` refuses. Each 64 take a plane of SLOTS words in the broadcast filters.
MAX_LANGS = 1024
UNKNOWN = "und"
_LUT = np.full(256, 32, np.uint8)
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts (letters in lower case, anything else a blank) and the text of each.

    Grams stay in their text and hold no two blanks side by side; each text has a blank before and after it.
    """
    n = len(bounds) - 1
    padded = np.full(len(buf) + 2 * n, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    padded[np.arange(len(buf)) + 2 * doc + 1] = _LUT[buf]
    blank = padded == 32
    double = np.concatenate([[False], blank[1:] & blank[:-1]])
    clean = padded[~double]  # runs of blanks become one, also where texts meet
    first = bounds + 2 * np.arange(n + 1)
    where = np.searchsorted(np.flatnonzero(~double), first)
    m = len(clean) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(m, np.uint64)
    for i in range(GRAM):
        packed = packed << np.uint64(8) | clean[i : i + m]
    # the blank where two texts meet may be the last of one and the first of the next: the character after it tells
    owner = np.searchsorted(where, np.arange(m) + (clean[:m] == 32), "right") - 1
    # a blank between two texts is the end of one and the start of the other: neither may reach beyond it
    inner = (packed >> np.uint64(8) & np.uint64(0xFFFF)).view(np.uint64)
    mid = (inner >> np.uint64(8) == 32) | (inner & np.uint64(0xFF) == 32)
    edge = np.zeros(len(clean), bool)
    edge[np.clip(where[1:-1], 0, len(clean) - 1)] = True
    crosses = np.zeros(m, bool)
    for i in range(1, GRAM - 1):
        crosses |= edge[i : i + m] & mid
    crosses |= edge[GRAM - 1 : GRAM - 1 + m] & (clean[GRAM - 1 : GRAM - 1 + m] != 32)
    keep = ~crosses
    return packed[keep], owner[keep]


@dataclass
class Filters:
    langs: list[str]  # the most frequent first
    planes: list[np.ndarray]  # the slots' bits, 64 languages in each plane
    false_rate: np.ndarray  # of each language

    @staticmethod
    def probes(g: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(g + np.uint64(0x9E3779B97F4A7C15))
        return [(h >> np.uint64(32 * k % 64) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]

    @classmethod
    def build(cls, langs: list[str], of: dict[str, np.ndarray], size: int = SLOTS) -> Filters:
        planes, fill = [], []
        for first in range(0, len(langs), 64):
            some = langs[first : first + 64]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(some))
            slots = np.zeros(size, kind)
            for i, x in enumerate(some):
                for at in cls.probes(of.get(x, np.zeros(0, np.uint64)), size):
                    slots[at] |= kind(1 << i)
            fill += [np.count_nonzero(slots & kind(1 << i)) / size for i in range(len(some))]
            planes.append(slots)
        return cls(langs, planes, np.array(fill) ** PROBES)

    def masks(self, g: np.ndarray, plane: int = 0) -> np.ndarray:
        """Of each n-gram, a bit for every language of the plane that contains it."""
        slots = self.planes[plane]
        a, *rest = self.probes(g, len(slots))
        out = slots[a]
        for at in rest:
            out &= slots[at]
        return out

    def judge(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[list[str], list[float], np.ndarray]:
        """Language, score, and number of n-grams of each text."""
        n = len(bounds) - 1
        g, owner = grams(buf, bounds)
        total = np.bincount(owner, minlength=n)
        share = np.zeros((len(self.langs), n))
        for plane in range(len(self.planes)):
            masks = self.masks(g, plane)
            for i in range(64 * plane, min(64 * plane + 64, len(self.langs))):
                hits = np.bincount(owner[(masks >> masks.dtype.type(i % 64) & masks.dtype.type(1)).astype(bool)], minlength=n)
                share[i] = hits / np.maximum(total, 1)
        share = np.clip((share - self.false_rate[:, None]) / np.maximum(1 - self.false_rate[:, None], 1e-9), 0, 1)
        best = share.argmax(0) if len(self.langs) else np.zeros(n, int)
        data, langs, scores = buf.tobytes(), [], []
        seen = np.concatenate([[0], np.cumsum(_LUT[buf] != 32)])[bounds]
        ascii_ = np.concatenate([[0], np.cumsum((_LUT[buf] != 32) & (buf < 128))])[bounds]
        for k in range(n):
            known = ascii_[k + 1] > ascii_[k] or seen[k + 1] > seen[k] and any(map(str.isalpha, data[bounds[k] : bounds[k + 1]].decode("utf-8", "replace")))
            langs.append(self.langs[best[k]] if known and self.langs else UNKNOWN)
            scores.append(float(share[best[k], k]) if known and self.langs else 0.0)
        return langs, scores, total


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Filters:
    """Filters from rows with text and lang. About ``fit_docs`` texts of each language, chosen by a hash of text, are read whole.

    Rows without text or lang teach nothing, and copies of a text teach once.  More labels than MAX_LANGS are an error.
    What reaches the driver is bounded: n-grams that MIN_SHARE of at most ``fit_docs`` documents have.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"), F.count(F.lit(1)).alias("_rows"))
    found = sizes.orderBy(F.desc("_rows"), "lang").limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    counts = {r["lang"]: max(r["n"], 1) for r in found}
    if not counts:
        return Filters([], [], np.zeros(0))
    span = 1 << 30
    part = spark.createDataFrame([(x, int(span * min(1.0, fit_docs / n)), max(1.0, MIN_SHARE * min(n, fit_docs))) for x, n in counts.items()], "lang string, _part long, _need double")
    part = F.broadcast(part)
    sample = rows.join(part.select("lang", "_part"), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(span)) < F.col("_part")).select("text", "lang").distinct()

    def count(batches):
        with working():
            for batch in batches:
                yield from counted(batch)

    def counted(batch):
        langs = np.array(batch.column(1).to_pylist(), object)
        for row, buf, bounds in utf8_chunks(batch.column(0)):
            mine = langs[row : row + len(bounds) - 1]
            g, owner = grams(buf, bounds)
            names, code = np.unique(mine.astype(str), return_inverse=True)
            pairs = np.unique(np.stack([g, owner.astype(np.uint64)], 1), axis=0) if len(g) else np.zeros((0, 2), np.uint64)
            key = np.stack([pairs[:, 0], code[pairs[:, 1].astype(int)].astype(np.uint64)], 1)
            key, n = np.unique(key, axis=0, return_counts=True) if len(key) else (key, np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(names[key[:, 1].astype(int)].tolist(), pa.string()), pa.array(key[:, 0].astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "df"])

    found = sample.mapInArrow(count, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    got = found.join(part.select("lang", "_need"), "lang").filter(F.col("df") >= F.col("_need")).select("lang", "gram", "df").toPandas()
    got["rate"] = got["df"] / got["lang"].map({x: min(n, fit_docs) for x, n in counts.items()})
    got = got[got["rate"] >= MIN_RATIO * got.groupby("gram")["rate"].transform("max")]
    return Filters.build(list(counts), {x: g["gram"].to_numpy().astype(np.uint64) for x, g in got.groupby("lang")})


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone.

    Null texts and texts without a letter: ``und`` and 0.  A text with letters that no
    filter knows gets the most frequent learned language and 0; with nothing learned, ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def kernel(batch: pa.RecordBatch):
        for row, buf, bounds in utf8_chunks(batch.column(1)):
            langs, scores, _ = shared.value.judge(buf, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(langs)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """The rows whose text has a known language with a score of ``least`` or more; all columns, no shuffle.

    A text with letters that is too short for an n-gram says nothing against itself and stays.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index("text")

    def keep(batches):
        with working():
            for batch in batches:
                ok: list[bool] = []
                for _, buf, bounds in utf8_chunks(batch.column(at)):
                    ok += [x != UNKNOWN and (s >= least or not n) for x, s, n in zip(*shared.value.judge(buf, bounds))]
                yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of learning; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fitted on rows that are not held out."""
    filters = fit(docs.filter(~held_out()))
    return predict(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
