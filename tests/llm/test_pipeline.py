"""Stages of the pipeline against brute force, on small fixtures."""

import random
import re
from hashlib import sha256

import corpus_pipeline
from lakegrain.llm import exact_dedup, near_dedup


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(base, at):
    return " ".join("edit" + str(i) if i in at else w for i, w in enumerate(base))


def test_near_threshold(spark):
    """A pair at 0.82 goes in the pipeline and stays in op3."""
    base = [f"w{i}" for i in range(300)]
    data = [(1, " ".join(base)), (2, edited(base, (20, 80, 140, 200, 240, 280))), (3, edited(base, range(0, 300, 30)))]
    a, b, c = (shingles(t) for _, t in data)
    assert 0.81 < len(a & b) / len(a | b) < 0.83 and len(a & c) / len(a | c) < 0.78
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [1, 2, 3]
    # what banding misses at the threshold
    assert near_dedup.band_rows(80) == 6 and (1 - 0.8**6) ** (near_dedup.BINS // 6) < 6.1e-5
    assert near_dedup.band_rows(50) < 6


def test_rows_go_by_themselves(spark):
    """Null ids hold copies too, and a repeated id holds a copy and a text of its own."""
    base = [f"w{i}" for i in range(200)]
    other, third = " ".join(f"x{i}" for i in range(100)), " ".join(f"y{i}" for i in range(100))
    a, near = " ".join(base), edited(base, (50,))
    data = [(3, a), (7, other), (7, a), (None, a), (None, third), (None, third + " "), (9, a), (9, a), (None, None), (4, " ")]
    cols = "doc_id long, text string, node int"
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], cols).repartition(3)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, a), (7, other), (None, third + " "), (4, " ")], key=str)
    data = [(3, a), (7, other), (7, near), (None, near), (None, third), (None, edited(third.split(), (50,))), (8, a), (3, a), (None, ""), (4, " ")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], cols).repartition(3)
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    thirds = [x for x in got if x[0] is None and x[1]]
    assert len(thirds) == 1 and thirds[0] in data
    assert [x for x in got if x not in thirds] == sorted([(3, a), (7, other), (None, ""), (4, " ")], key=str)


def brute_chain(rows, items):
    """Ids and texts that a chain of brute-force stages leaves. Of a repeated id no two rows may be linked."""
    order = lambda i: (i is None, i or 0)
    rows = [(i, t) for i, t in rows if re.search("[a-z]", t or "")]
    best = {}
    for i, t in rows:
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", t), (-len(t), order(i))
        if key not in best or rank < best[key][0]:
            best[key] = rank, i, t
    rows = [x[1:] for x in best.values()]
    sets = [shingles(t) or {tuple(t.split())} for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                label = [label[y] if k == label[x] else k for k in label]
    rows = [min((rows[k] for k in range(len(rows)) if label[k] == c), key=lambda r: order(r[0])) for c in set(label)]
    wins = set()
    for _, t in items:
        w = re.findall("[a-z]+", (t or "").lower())
        wins |= {" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9)) if w}
    return [(i, t) for i, t in rows if not any(x in f" {' '.join(re.findall('[a-z]+', t.lower()))} " for x in wins)]


def test_run(spark, tmp_path):
    """The whole chain on copies, near copies at 0.82, null and repeated ids, benchmark passages and short texts."""
    rng = random.Random(8)
    parts = {"aa": ["ka", "la", "mo", "ro", "ti", "ki", "su", "na"], "bb": ["schno", "praft", "wirk", "zung", "gelm", "stro"]}
    text = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randrange(2, 4))) for _ in range(n))
    rows = [(i, text(x, rng.randrange(3, 120)), x) for i, x in enumerate(rng.choice(["aa", "bb"]) for _ in range(200))]
    base = text("aa", 300).split()
    near = list(base)
    for k in (20, 80, 140, 200, 240, 280):
        near[k] = text("aa", 1) + "kamola"
    a, b = " ".join(base), " ".join(near)
    assert 0.8 < len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85
    rows += [(300, a, "aa"), (301, b, "aa"), (None, a, "aa"), (None, a + "  ", "aa"), (302, a, "aa"), (7000, text("bb", 50), "bb"), (7000, rows[5][1], rows[5][2])]
    rows += [(None, text("bb", 40), "bb"), (None, text("aa", 40), "aa"), (400, "moro tiki", "aa"), (401, "123 !! 456", "aa"), (402, None, "aa"), (403, "", "bb")]
    passage = text("bb", 14)
    rows += [(k, text("bb", 30) + " " + passage + " " + text("bb", 30), "bb") for k in (500, 501, None)]
    items = [(1, passage[: passage.rindex(" ")]), (2, None), (3, text("aa", 30))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_chain([r[:2] for r in rows], items)
    got = [(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, sha256(t.encode()).hexdigest()) for i, t in want), key=str)
    ids = [i for i, _ in got]
    # of the exact copies the longest stays, which has no id; of near copies the one with an id
    assert ids.count(None) == 2 and ids.count(7000) == 1 and {301, 400} <= set(ids) and not {300, 302, 401, 402, 403, 500, 501} & set(ids)
