"""Registered queries over whole tables, on fixtures in place of a table, against brute force."""

import os
import random
import re

import __spark_entry__

SF = "/root/testdata/sf0.001"


def with_table(spark, tmp_path, name, rows, schema):
    """A folder of tables in which one is made of ``rows``."""
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_keywords_of_documents(spark, tmp_path):
    rng = random.Random(2)
    data = [(1, None), (2, ""), (3, " ;,\t'\""), (4, "a b,a;c\td\ne"), (5, "'two words' \"and; these\" x'y"), (6, "' padded ' '' \"it's\""), (7, "a b,a;c\td\ne"), (7, "a f"), (None, "a g")]
    data += [(8, " ".join("w" + str(rng.randrange(3000)) for _ in range(20000)))] + [(100 + i, f"hot words of {i}") for i in range(300)]
    want = set()
    for i, t in data:
        for x in re.findall(r"""'[^']*'|"[^"]*"|[^;, \x0B\x08\f\r\t\n'"]+""", t or ""):
            term = x[1:-1].strip(" ") if x[0] in "'\"" else x
            want |= {(term, i)} - {("", i)}
    sf = with_table(spark, tmp_path, "documents", data, "doc_id long, text string")
    q = __spark_entry__.queries()
    got = [tuple(r) for r in q["x_term_doc_text"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and ("two words", 5) in want
    n = {}
    for term, _ in want:
        n[term] = n.get(term, 0) + 1
    assert sorted(map(tuple, q["x_keyword_counts_text"](spark, sf).collect())) == sorted(n.items()) and n["hot"] == 300


def test_components_of_all_orders(spark, tmp_path):
    """Orders and parts far apart are cells of their own, and every cell counts."""
    rng = random.Random(4)
    keys = [(o, n) for o in [*range(1, 60), *range(301, 340), 100001] for n in range(1, 8) if rng.random() < 0.7]
    data = [(o, o % 13, n, float(rng.randrange(1, 51))) for o, n in keys] + [(1, 5, 1, 20.0)]
    sf = with_table(spark, tmp_path, "lineitem", data, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    hits = {(o, n) for o, _, n, x in data if x > 12}
    label = {c: c[0] * 8 + c[1] for c in hits}
    while True:
        new = {(o, n): min(label[c] for c in [(o, n), (o - 1, n), (o + 1, n), (o, n - 1), (o, n + 1)] if c in hits) for o, n in hits}
        if new == label:
            break
        label = new
    q = __spark_entry__.queries()
    seen = {}
    for r in q["g_components_all"](spark, sf).collect():
        for n in range(r.first, r.last + 1):
            assert (r.c0, n) not in seen
            seen[r.c0, n] = r.component
    assert seen == label and len(set(label.values())) > 10
    boxes = q["g_block_components"](spark, sf).collect()
    of, count = {}, 0
    for r in boxes:
        for o in range(r.lo0, r.hi0 + 1):
            for n in range(r.lo1, r.hi1 + 1):
                of[o, n], count = r.component, count + 1
    assert set(of) == hits and count == len(hits)  # every hit once
    pairs = {(label[c], of[c]) for c in hits}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert sorted(map(tuple, q["g_blocks"](spark, sf).collect())) == sorted((r.lo0, r.hi0, r.lo1, r.hi1) for r in boxes)
