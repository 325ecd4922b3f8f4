"""Keywords of texts with and without quotes, and pairs of documents of one row and of several."""

import random
import re

from pyspark.sql import functions as F

from lakegrain.operators import text

_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[^;, \x0B\x08\f\r\t\n'"]+""")


def keywords(t):
    found = (x[1:-1].strip(" ") if x[0] in "'\"" else x for x in _TOKEN.findall(t or ""))
    return [x for x in found if x]


def test_tokens_of_odd_texts(spark):
    rng = random.Random(9)
    plain, odd = "ab;, \x0b\x08\x0c\r\t\n\x00\x85  é.", "ab;, \n'\" "
    texts = ["".join(rng.choice(c) for _ in range(rng.randrange(30))) for c in (plain, odd) for _ in range(200)] + ["", None, " ", "a", "''", "'\n'", "x' y 'z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, got in df.select("i", text.tokens(F.col("t"))).collect():
        assert (got or []) == keywords(texts[i]), repr(texts[i])


def test_pairs_need_an_exchange_only_for_documents_of_several_rows(spark):
    data = [(i, f"w{i % 7} both w{i % 11} both 'q {i % 3}'") for i in range(300)]
    unique = spark.createDataFrame(data, "d int, t string").repartition(3)
    pairs = {(w, i) for i, t in data for w in keywords(t)}
    out = text.term_document(unique, "t", "d")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(term" not in final
    again = unique.union(spark.createDataFrame([(5, "both w9"), (5, "new"), (None, "both x"), (None, "both y")], "d int, t string"))
    pairs |= {("w9", 5), ("new", 5), ("both", None), ("x", None), ("y", None)}
    got = [tuple(r) for r in text.term_document(again, "t", "d").collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    counts = {}
    for w, _ in pairs:
        counts[w] = counts.get(w, 0) + 1
    assert dict(map(tuple, text.keyword_counts(again, "t", "d").collect())) == counts
