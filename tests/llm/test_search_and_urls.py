"""Top-k search and URL filtering against plain Python."""
import math
import random

import pytest

from packetloom.llm import topk_search, url_filter


def brute(rows, queries, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted(queries):
        vector = dict(usable).get(q)
        if vector is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in usable if i != q)
        out += [(q, n + 1, i, max(-2**63, min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_k(spark, scale):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) * scale for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(200)]  # many equal vectors, and so ties
    rows += [(700, None), (800, [1.0, None, 0.0]), (801, [float("nan")] * 6), (900, [float("inf")] * 6), (None, [0.5] * 6),
             (1000, [0.5, -0.5]), (1100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    frame = frame.selectExpr("*", "'x' AS v", "1 AS _n", "2 AS score")
    found = topk_search.top_k(frame, frame.filter("vec_id % 100 = 0"), block=4)
    queries = [i for i, _ in rows if i is not None and i % 100 == 0]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, queries, 10))


def test_fewer_candidates_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    found = topk_search.top_k(frame, frame.filter("vec_id = 0"), k=10).collect()
    assert [tuple(r) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1, 2048 * 1024), (0, 2, 2, 2048 * 1024)]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none, none).collect() == []
    assert topk_search.top_k(none, some).collect() == []
    assert topk_search.top_k(some, some).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"), ("Example.com", "/en/a", "block"), ("b.net", "", "block"), ("net", "/es/x/y", "allow"), (None, "/", "block")]


def test_urls(spark):
    rnd = random.Random(4)
    hosts = ["com", "example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "net", "b.net", "c.b.net", ".net", "example.com.",
             "example.com:80", "", "é.com", "org"]
    paths = ["", "/", "/en/", "/en", "/en/a", "/en/ab/c", "/es/x/y/z", "/es/", "/fr/?q=/en/", "/fr#x", "?x=/en/", "/EN/", "/es/x", "/é/"]
    rows = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(700)]
    rows += [(700 + i, f"http://www.example.com/en/{i}") for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "www.example.com/en/"), (5, "http://b.net/"), (None, "http://net/es/://com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS part")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    expected = []
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            rest = rest[end:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in RULES
                if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        expected.append((i, host, path, best[2], best[3]))
    found = [tuple(r) for r in url_filter.filter_urls(pages, rules).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_no_urls_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert [r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == ["allow"]
