"""Token store, token counts and BPE against the libraries, on small fixtures."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakegrain.llm import bpe, bpe_codec, token_counts, token_store

ODD = ["", None, " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n \nb", "<|endoftext|>", "x <|endoftext|> y  z", "don't  'll \t x", "　 　日本 語", "é\u0085 \u0085", "x" * 9000, "the " * 3000, "123 456  789,., !!", "a\x00b \x00 c"]
ROWS = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(5, "the cat sat"), (5, "the cat sat"), (None, "no id"), (10**12, "last one")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, n_tokens string, start int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    r = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r, special_tokens={})


def test_store(docs, library):
    store = token_store.write_store(docs)
    got = {}
    for r in token_store.read_report(store).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32, r.start))
    want, total = {}, 0
    for i, t in ROWS:
        ids = array("I", library.encode(t or "", add_special_tokens=False).ids + [2])
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {k: sorted(x[:2] for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for i in sorted(got, key=lambda i: (i is not None, i)):
        for n, _, start in sorted(got[i], key=lambda x: x[2]):
            assert start == total
            total += n
    back = {}
    for r in token_store.read_documents(store).collect():
        back.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert sorted(back[5]) == sorted(array("I", library.encode(t, add_special_tokens=False).ids + [2]).tobytes() for i, t in ROWS if i == 5)
    chunks = store.table("data").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_damage_is_found(docs, spark):
    store = token_store.write_store(docs)
    data = store.table("data")
    bad = token_store.Store(spark, store.at + "-bad")
    from pyspark.sql import functions as F

    data.withColumn("payload", F.when(F.col("n_ids") > 100, F.lit(b"\x02zz")).otherwise(F.col("payload"))).write.partitionBy("kind").parquet(bad.at + "/data")
    for t in ("order", "manifest"):
        store.table(t).write.parquet(f"{bad.at}/{t}")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_report(bad).collect()


def test_store_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_report(token_store.write_store(empty)).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    assert bpe_codec.encode_documents(empty).count() == 0


def test_crc_joins():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(50))
        assert token_store.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_flat_counts_across_blocks(docs, spark, library):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    folder, rows = token_counts.write_flat(docs)
    files = rows.groupBy("file").agg({"bytes": "max"}).withColumnRenamed("max(bytes)", "bytes")
    for block in (2, 64, 1 << 20):  # documents span many blocks, a few, one
        got = token_counts.count_flat(spark, files, folder, block=block).join(rows, ["file", "place"]).select("doc_id", "n_tokens")
        want = sorted(((i is not None, i or 0, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS))
        assert sorted((r[0] is not None, r[0] or 0, r[1]) for r in got.collect()) == want
        if block == 2:
            break_after = got.count()
            assert break_after == len(ROWS)


def test_codec(docs, ranks):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.encode_documents(docs).collect())
    want = []
    for i, t in ROWS:
        ids = array("I", ranks.encode_ordinary(t or ""))
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_prefix_table(ranks):
    dp = bpe.PrefixBpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabcdetrhn' \xc3\xa9") for _ in range(rng.randrange(1, 30)))
        table = dp.table(piece)
        assert dp.read(table) == dp.merges(piece)
        assert [dp.read(table, i) for i in range(len(piece) + 1)] == [dp.merges(piece[:i]) for i in range(len(piece) + 1)]
        more = bytes(rng.choice(b"aehrt") for _ in range(5))
        data, longer = dp.append(piece, list(table), more)
        assert dp.read(longer) == dp.merges(piece + more)
        at = rng.randrange(len(piece))
        data, edited = dp.edit(piece, list(table), at, 1, b"th")
        assert dp.read(edited) == dp.merges(data)


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50000, 20000).astype("<u4")
    ends = token_store.cuts(ids, np.array([0, len(ids)]))[0]
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MOST
    shifted = token_store.cuts(np.concatenate([ids[:100], ids]), np.array([0, 100, len(ids) + 100]))[1]
    assert shifted == ends
    moved = token_store.cuts(np.concatenate([ids[-300:], ids]), np.array([0, len(ids) + 300]))[0]
    assert len({e - 300 for e in moved} & set(ends)) > len(ends) // 2
