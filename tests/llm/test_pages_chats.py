"""URL filter and chat format against brute force."""

import random
from hashlib import sha256

import pytest

from lakegrain.llm import chat_format as C
from lakegrain.llm import url_filter as U

RULES = [*U.RULES, ("com", "/en/", "allow"), ("www.example.com", "/", "block"), ("com", "/en/7", "block"), ("", "", "block"), ("co.uk", "", "block"), ("m.co.uk", "/a", "allow")]
URLS = [None, "", "no scheme", "http://", "http://COM/en/", "https://a.example.com/en/77?x=/de/", "http://example.com/en/7#a", "http://badexample.com/en/7", "x://www.example.com", "x://www.example.com/q", "ftp://a.b.example.net/de/8/1", "http://net?/de/", "http://net/de/8", "http://org/es", "http://org/es/\n", "http://a.co.uk", "http://m.co.uk/ab", "http://Ünet/de/", "http://..com/en/", "http://x.com:80/en/", "a://b://com/en/"]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if (host == h or h and host.endswith("." + h)) and path.startswith(p):
            k = (len(h) + len(p), len(h), v)
            best = max(best, (k, h + p, v)) if best else (k, h + p, v)
    return (host, path, best and best[1], best[2] if best else "allow")


def test_urls(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'www', 'example', 'm']) for _ in range(rng.randrange(3)))}.{rng.choice(['com', 'net', 'org', 'example.com', 'co.uk'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(99)}" for _ in range(200)] + ["http://hot.example.com/en/7"] * 300
    pages = spark.createDataFrame([(None if i == 3 else i // 2, u, "x", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, key int").repartition(5)
    got = U.judge_urls(pages, U.rules_table(spark, RULES))
    want = sorted(map(str, ((None if i == 3 else i // 2, *brute(u, RULES)) for i, u in enumerate(urls))))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_no_pages_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = U.rules_table(spark, [])
    assert [tuple(r) for r in U.judge_urls(pages, rules).collect()] == [(1, "a.com", "/x", None, "allow")]
    assert U.judge_urls(pages.limit(0), U.rules_table(spark)).count() == 0


HARD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "a\\", "\\\\</s>", "[INST] x", " [/INST]", "<<SYS>>\nq\n<</SYS>>\n", "[TURN a] b [/TURN]", "\\[INST] ", "x [/INST", "</s", "\\n \\", "é [/INST] ü", "\x00"]


@pytest.mark.parametrize("role", ["user", "system", "assistant", "tool", "", "a] b", "us\\er", "[INST] "])
def test_turns_round_trip(role):
    for t in HARD:
        s = C.render_turn(role, t)
        assert C.parse(s) == [(role, t)]
        for r2, t2 in (("assistant", t), ("user", "[/INST]")):
            assert C.parse(s + C.render_turn(r2, t2)) == [(role, t), (r2, t2)]
    assert C.render_turn("user", "plain [text] <b>") == "[INST] plain [text] <b> [/INST]"  # no escape without need


def test_random_round_trips():
    rng = random.Random(2)
    bits = ["[INST] ", " [/INST]", "</s>", "\\", "<<SYS>>\n", "\n<</SYS>>\n", "[TURN ", "] ", " [/TURN]", "a", " ", "[", "<", "é"]
    for _ in range(2000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randrange(3))) if rng.random() < 0.3 else rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for _ in range(4)]
        assert C.parse("".join(C.render_turn(*t) for t in turns)) == turns


def test_report(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "system", "tool"]), rng.choice([None, *HARD])) for _ in range(150)]
    got = {r.conv_id: tuple(r)[1:] for r in C.chat_report(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(4)).collect()}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r.decode(), x.decode()) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(C.render_turn(r, x) for r, x in turns)
        assert got[c] == (len(turns), sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(whole))
    assert C.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
