"""Byte-level BPE encoding and decoding of documents by prefix dynamic programming (see :mod:`.bpe`)."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PrefixPieces
from .common import engine, map_arrow
from .kernels import utf8_chunks

RANKS = "byte_bpe_multi_50k.tiktoken"


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the packed ids and decoded bytes.

    A null or empty text has no ids.  Texts are encoded whole, a bounded number of
    bytes at a time; ids and digests are those of the single text.  Ids are little-endian
    unsigned 32-bit.  Only the id and text columns are read; repeated and null ids are passed on.
    """
    path = path or public_tokenizers.path(RANKS)

    def kernel(batch: pa.RecordBatch):
        codec = engine(PrefixPieces, path)
        for row, buf, bounds in utf8_chunks(batch.column(1)):
            n = len(bounds) - 1
            ids, at = codec.encode_chunk(buf, bounds)
            text, ends = codec.decode_chunk(ids, at)
            raw, text, at, ends = memoryview(ids.tobytes()), memoryview(text.tobytes()), at.tolist(), ends.tolist()
            packed = [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]
            plain = [text[a:b] for a, b in zip(ends, ends[1:])]
            cols = [
                batch.column(0).slice(row, n),
                pa.array([len(x) >> 2 for x in packed], pa.int64()),
                pa.array([sha256(x).hexdigest() for x in packed]),
                pa.array([sha256(x).hexdigest() for x in plain]),
            ]
            if keep_ids:
                cols += [pa.array(map(bytes, packed), pa.binary()), pa.array(map(bytes, plain), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)
