"""URL rules against a plain loop over all rules, with and without shards and collisions."""

import random
import re

import numpy as np
import pytest

from corpuskit.llm import url_filter as U


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def cases():
    rng = random.Random(2)
    names, tops = ["a", "www", "Example", "b-c", "x"], ["com", "net", "org"]
    paths = ["", "/", "/en/", "/en/x.html", "/EN/", "/fr", "/é/1", "/en//2"]
    urls = [None, "", "no scheme", "http://", "://COM/", "http://com", "http://com./en/", "https://u@www.example.com:80/en/", "x://a\nb.com/en/\n", "http://.net/es/", "http://net?x=/es/"]
    for _ in range(300):
        host = ".".join([rng.choice(names) for _ in range(rng.randrange(4))] + [rng.choice(tops)])
        urls.append(f"http://{host}{rng.choice(paths)}{rng.choice(['', '?q=://a', '#t'])}")
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block"}
    for _ in range(60):
        host = ".".join([rng.choice(names).lower() for _ in range(rng.randrange(3))] + [rng.choice(tops)])
        rules[(host, rng.choice(paths))] = rng.choice(["allow", "block"])
    return urls, [(h, p, v) for (h, p), v in rules.items()]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_all_rules(spark, limit):
    urls, rules = cases()
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)] + [(None, urls[9], None, None)], "page_id long, url string, verdict string, shard int")
    found = U.judge(pages, spark.createDataFrame(rules, U.RULES), index_limit=limit, shard_bytes=1000)
    assert found.columns == ["page_id", "url", "shard", "host", "path", "rule", "verdict"]
    rows = found.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules), r.url
    none = U.judge(pages, spark.createDataFrame([], U.RULES), index_limit=limit)
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert U.judge(pages.limit(0), spark.createDataFrame(rules, U.RULES), index_limit=limit).collect() == []


def test_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(U, "digest", lambda texts: np.array([len(t) % 3 for t in texts], np.uint64))
    rules = [(b"a.com", b"/", b"block"), (b"b.com", b"/", b"allow"), (b"net", b"/es/", b"block")]
    index = U.DigestIndex.mapped(U.DigestIndex.dump(rules))
    assert index.find([b"a.com", b"b.com", b"c.com", b"net", b"ne"], [b"/", b"/", b"/", b"/es/", b"t/es/"]) == [b"block", b"allow", None, b"block", None]


def test_query_covers_all_pages(spark, small):
    from corpuskit.llm.queries import OP8_RULES, QUERIES

    rows = QUERIES["op8_url_filter"](spark, small).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], OP8_RULES)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_clashing_columns_stay(spark, limit):
    from corpuskit.llm.queries import OP8_RULES

    schema = "url string, row int, __host string, at_host string, `a.b` int, found string, h string, verdict string"
    df = spark.createDataFrame([("http://x.net/fr/a", 1, "one", "two", 3, "four", "five", "old")], schema)
    got = U.judge(df, spark.createDataFrame(OP8_RULES, U.RULES), index_limit=limit).first().asDict()
    assert got == {
        "url": "http://x.net/fr/a", "row": 1, "__host": "one", "at_host": "two", "a.b": 3, "found": "four", "h": "five",
        "host": "x.net", "path": "/fr/a", "rule": "net/fr/", "verdict": "block",
    }
