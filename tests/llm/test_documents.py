"""Operators on documents against brute force, on fixtures with nulls, ties, repeats, long texts and clashing columns."""

import random
import re
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegrain.llm import decontaminate, exact_dedup, language_id, near_dedup, substring_dedup

ALPHABET = "the of and in to is it on as at by or be we an if no so up my do go he me us".split()


def words(rng, n):
    return [rng.choice(ALPHABET) + rng.choice(["", "a", "er", "ing", "x" * 3]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = words(rng, 300)
    passage = " ".join(words(rng, 60))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "a\u00a0b"), (7, "é" * 400)]
    out += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base) + "  "), (None, " ".join(base))]
    for i in range(20, 45):  # near copies, some linked by way of others only
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append((i, " ".join(w)))
    for i in range(50, 60):  # one passage in many texts
        out.append((i, " ".join(words(rng, rng.randrange(0, 40))) + " " + passage + " " + " ".join(words(rng, rng.randrange(0, 40)))))
    out += [(60, "ab" * 500), (61, "z" * 5000), (62, passage[:199]), (63, " ".join(words(rng, 6000))), (64, "four words are few"), (64, "four words are few"), (65, "Four words ARE few")]
    out += [(100 + i, " ".join(words(rng, rng.randrange(1, 120)))) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "x", 1, True, 2, "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n int, kept boolean, node int, label string").repartition(3).cache()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_exact(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        want.setdefault(i, []).append((None if best[1] else best[2], len(groups[key]), sha256(key.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs)
    assert {k: [(x[0], x[1], x[3]) for x in v] for k, v in by_id(got).items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert got.filter("kept").count() == len(groups)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    # rows with a null id cannot be named, so they stay
    assert left.filter("doc_id is not null").count() == len(groups)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            par[find(a)] = find(b)
    comp = {}
    for k, (i, _) in enumerate(rows):
        comp.setdefault(find(k), []).append(i)
    return sets, [min((x for x in comp[find(k)] if x is not None), default=None) for k in range(len(rows))]


def test_near(docs, rows):
    sets, comp = brute_components(rows)
    want = {}
    for (i, _), s, c in zip(rows, sets, comp):
        want.setdefault(i, []).append((len(s), c, c is None or i == c))
    assert by_id(near_dedup.near_dedup(docs)) == {k: sorted(v, key=str) for k, v in want.items()}


def test_near_on_a_chain(spark):
    """Each links with the next only; with buckets full of others that link with none."""
    base = [f"w{i}" for i in range(200)]
    data = []
    for k in range(12):
        w = list(base)
        for j in range(k):
            for x in range(3):
                w[j * 15 + x] = f"edit{j}{x}"
        data.append((100 - k, " ".join(w)))
    rng = random.Random(3)
    for k in range(12):
        w = list(base)
        for _ in range(9):
            w[rng.randrange(200)] = f"own{k}-{rng.random()}"
        data.append((200 + k, " ".join(w)))
    _, comp = brute_components(data)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), c in zip(data, comp)}


def brute_repeats(texts, length):
    starts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            starts.setdefault(t[i : i + length], []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in starts.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + length] = True
    return gone


def test_substrings(docs, rows):
    texts = [(t or "").encode() for _, t in rows]
    want = {}
    for (i, _), t, g in zip(rows, texts, brute_repeats(texts, 200)):
        edge = np.diff(np.concatenate([[0], g.astype(int)]))
        kept = bytes(b for b, x in zip(t, g) if not x)
        want.setdefault(i, []).append((len(t), int(g.sum()), int((edge == 1).sum()), sha256(kept).hexdigest()))
    assert by_id(substring_dedup.remove_repeats(docs)) == {k: sorted(v, key=str) for k, v in want.items()}


def test_suffix_array():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 7, 50, 51, 52, 300]:
        s = np.array([rng.randrange(3) for _ in range(n)])
        assert substring_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    texts = [b"abracadabra" * 30, b"xx" + b"abracadabra" * 20, b"", bytes(range(250)), b"zz" + bytes(range(250))]
    for got, t, want in zip(substring_dedup.repeated_windows(texts, 100), texts, brute_repeats(texts, 100)):
        cover = np.zeros(len(t), bool)
        for i in np.flatnonzero(got):
            cover[i : i + 100] = True
        assert (cover == want).all()


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 30])
def test_decontaminate(spark, docs, rows, block):
    text = dict(rows)
    items = [(2, " ".join(text[50].split()[-30:])), (10, "Four, words! are few"), (11, None), (12, "?!"), (13, text[63][5000:5300].upper()), (2, "one two"), (14, "never seen in any text of these at all")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    wins = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(0, len(w) - 9) if len(w) >= 10 else bool(w)):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in rows:
        w, hit, seen = item_words(t), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    seen |= of
        want.setdefault(i, []).append((len(w), len(hit), ",".join(sorted(seen))))
    got = decontaminate.scan_windows(docs, bench, block=block).selectExpr("doc_id", "n_words", "aggregate(spans, 0, (a, x) -> a + x.last - x.first) n", "array_join(items, ',') i")
    assert by_id(got) == {k: sorted(v, key=str) for k, v in want.items()}
    clean = decontaminate.decontaminate(docs, bench, block=block)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, v in want.items() for x in v if x[1] == 0)
    cut = {r.doc_id: r.text for r in decontaminate.strip_spans(docs.filter("doc_id = 64 or doc_id = 1"), bench).collect()}
    assert cut == {64: "", 1: None}


def test_blocks_change_nothing(spark, docs, rows):
    """Null and repeated ids, and one id with two texts, stay rows of their own however many blocks there are."""
    more = spark.createDataFrame([(50, "no hit in here"), (None, "four words are few " * 3)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more).cache()
    text = dict(rows)[50].split()
    items = [(2, " ".join(text[-30:])), (3, " ".join(text[-45:-15])), (4, "four words"), (5, "are few"), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.scan_windows(every, bench, block=b).collect())) for b in (decontaminate.BLOCK, 1))
    assert len(list(decontaminate._blocks(bench, decontaminate.WINDOW, 1))) == 4
    assert len(one) == len(rows) + 2 and many == one
    assert sum("items=['4', '5']" in r for r in one) == 4


def test_language(spark):
    rng = random.Random(9)
    langs = {"aa": ["kala", "moro", "tiki", "suna"], "bb": ["schno", "praft", "wirk", "zung"], "cc": ["éloué", "çatre", "ñouve", "ümbe"]}
    data = [(i, " ".join(rng.choice(langs[x]) for _ in range(rng.randrange(3, 200))), x) for i, x in enumerate(rng.choice(list(langs)) for _ in range(300))]
    data += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !! 456", "cc"), (1003, "moro tiki suna", None), (1003, "moro tiki suna", None), (None, "wirk zung", "bb"), (1004, "a", "aa"), (1005, "… —", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("no"))
    got = language_id.language_report(df).collect()
    assert len(got) == len(data)
    lang = {i: x for i, _, x in data}
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.lang_pred for r in got}
    assert [of[i] for i in (1000, 1001, 1002, 1005)] == ["und"] * 4 and of[1003] == "aa" and of[None] == "bb" and of[1004] in langs
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = language_id.keep_known(df, language_id.fit(df), 0.3)
    assert kept.columns == df.columns and kept.filter("doc_id in (1000, 1001, 1002, 1005)").count() == 0
    assert kept.filter("doc_id < 1000").count() == 300 and kept.filter("doc_id = 1004").count() == 1


def gram_sets(t):
    """The n-grams of a text by definition: letters in lower case, runs of anything else one blank, a blank at both ends."""
    out = bytearray(b" ")
    for b in t.encode():
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or out[-1] != 32:
            out.append(c)
    if out[-1] != 32:
        out.append(32)
    return [int.from_bytes(out[i : i + 4], "big") for i in range(len(out) - 3)]


def test_language_by_definition(spark):
    """70 languages, more than a word has bits, against counts in plain Python with sets in the filters' place."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(5)) for _ in range(280)]
    names = [f"l{k:02d}" for k in range(70)]
    of = {x: stems[4 * k : 4 * k + 4] for k, x in enumerate(names)}
    data = [(i, " ".join(rng.choice(of[x]) for _ in range(rng.randrange(4, 30))), x) for i, x in enumerate(names * 8)]
    data += [(10_000 + k, data[0][1], data[0][2]) for k in range(40)]  # copies teach once
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    filters = language_id.fit(df)
    assert sorted(filters.langs) == names and len(filters.planes) == 2
    rate = {}
    for x in names:
        texts = {t for _, t, y in data if y == x}
        for g in {g for t in texts for g in gram_sets(t)}:
            rate.setdefault(g, {})[x] = sum(g in gram_sets(t) for t in texts) / len(texts)
    known = {x: {g for g, r in rate.items() if x in r and r[x] >= language_id.MIN_RATIO * max(r.values())} for x in names}
    for r in language_id.predict(df, filters).collect():
        grams = gram_sets(dict((i, t) for i, t, _ in data)[r.doc_id])
        share = {x: sum(g in known[x] for g in grams) / len(grams) for x in names}
        assert share[r.lang_pred] == max(share.values()) and abs(r.score - share[r.lang_pred]) < 0.02


def test_false_positives_are_taken_out():
    rng = np.random.default_rng(1)
    known = rng.integers(0, 1 << 32, 3000).astype(np.uint64)
    f = language_id.Filters.build(["a", "b"], {"a": known}, 1 << 13)
    other = rng.integers(0, 1 << 32, 20000).astype(np.uint64)
    assert (f.masks(known) & 1).all()
    assert abs((f.masks(other) & 1).mean() - f.false_rate[0]) < 0.02 and f.false_rate[1] == 0


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for got in (exact_dedup.exact_dedup(empty), near_dedup.near_dedup(empty), substring_dedup.remove_repeats(empty), decontaminate.scan_windows(empty, bench), language_id.language_report(empty), exact_dedup.drop_copies(empty), near_dedup.drop_near_copies(empty), decontaminate.decontaminate(empty, bench)):
        assert got.count() == 0
