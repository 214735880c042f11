import random

import pytest

from boxquery.llm.url_rules import RuleTrie, blocked_out, judge, split_url

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/es"), ("block", "x.net", ""), ("allow", "x.net", "/a/b"), ("allow", "dup.org", "/q"), ("block", "dup.org", "/q")]
SCHEMA = "page_id bigint, url string, rule int, verdict string"


def plain(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [(len(h.split(".")), len(p), v == "block", f"{h}{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


def random_urls(n):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "notexample.com", "EXAMPLE.com", "x.net", "y.x.net", "net", ".net", "net.", "dup.org", "", "com:80"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/EN/", "/es", "/es/", "/est", "/a/b", "/a/bc/d", "/a/", "/q", "//", "/es?x", "#y", "?z", "/a/b#/en/"]
    return [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]


@pytest.mark.parametrize("per_trie", [1, 2, 100])
def test_judged_as_by_hand(spark, per_trie):
    urls = [None, "", "no scheme", "a://b://c/d", "://", "http://é.com/\n/en/", *random_urls(400), "http://com/" + "x/" * 50_000]
    rows = [(i or None, u, 1, "clash") for i, u in enumerate(urls)] + [(1, "", 1, "clash")]
    got = judge(spark.createDataFrame(rows, SCHEMA), RULES, rules_per_trie=per_trie).collect()
    want = [(i, *plain(u, RULES)) for i, u, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_default_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (2, "http://b/x")], "page_id bigint, url string")
    assert {r["verdict"] for r in judge(pages, [], default="block").collect()} == {"block"}
    assert judge(pages.limit(0), RULES).collect() == []
    assert [r["page_id"] for r in blocked_out(pages, [("block", "a", "")]).collect()] == [2]


def test_rules_are_checked():
    for rule in (("deny", "a", "/"), ("allow", "a", "b")):
        with pytest.raises(ValueError):
            RuleTrie([rule])
