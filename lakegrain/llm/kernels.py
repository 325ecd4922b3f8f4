"""Hashes and chunks of text as numpy arrays. Loads numpy and Arrow only, so that workers which need no tokenizer stay small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time; a longer text makes a chunk alone.
CHUNK = 2 << 20


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenates flat[starts[w]:starts[w] + lens[w]] for each w of ``which``."""
    n = lens[which]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(ends[-1])
    return flat[at]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULTIPLY = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)
#: Words of 8 bytes that are mixed for all spans together; longer spans are hashed one by one.
_TOGETHER = 8


def span_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int = 2, together: int = _TOGETHER) -> list[np.ndarray]:
    """n independent hashes of 64 bits of each span, 8 bytes at a time. A span's hash depends on its bytes alone."""
    data = buf.tobytes() + bytes(8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = stops - starts
    out = [mix(left.astype(np.uint64) * _MULTIPLY[k]) for k in range(n)]
    long = np.flatnonzero(left > 8 * together)
    at, which = starts, np.arange(len(starts))
    for _ in range(together):
        w = words[at] & _MASKS[np.minimum(left, 8)]
        for k in range(n):
            h = (out[k][which] ^ w) * _MULTIPLY[k]
            out[k][which] = h ^ (h >> np.uint64(32))
        more = left > 8
        if not more.any():
            break
        at, left, which = at[more] + 8, left[more] - 8, which[more]
    if len(long):
        import xxhash
    for x in long.tolist():
        h = xxhash.xxh3_128_intdigest(data[starts[x] : stops[x]])
        for k in range(n):
            out[k][x] = h >> 64 * k & 0xFFFFFFFFFFFFFFFF
    return [mix(h) for h in out]


def utf8_chunks(column, most: int = CHUNK):
    """An Arrow string column (nulls: empty) as (first row, bytes, bounds) of rows of about ``most`` bytes at most."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
