"""Operator 11 against plain string comparisons."""

import pytest

from scoreloom.llm import url_filter as U

URLS = [
    None, "", "no scheme/com/en/", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/b", "https://notexample.com/en/1", "http://example.com", "http://example.com?/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/FR/",
    "http://u:p@h.com:80/a/b#c", "://x.org/", "http:///en/", "http://a..com/", "http://.com/", "http://com./", "ftp://x.org/q/http://y.com/", "http://é.com/ü/\nz?w", "http://b.spam-farm.example.org/en/1", "http://spam-farm.example.org", "http://x.net/" + "es/" * 20_000, "http://" + "a." * 20_000 + "net/es/",
]
LISTS = ([*U.BASE_RULES], [*U.OWN_RULES], [("org", "/q", "block"), ("x.org", "/", "allow"), ("org", "", "block"), ("h.com:80", "/a/b", "allow")])


def brute(url, lists, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    for k, one in enumerate(lists):
        fit = [(len(h) + len(p), len(h), v == "block", h, p, v) for h, p, v in one if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            _, _, _, h, p, v = max(fit)
            return host, path, h + p, k, v
    return host, path, None, None, default


@pytest.mark.parametrize("salted", [None, True])
@pytest.mark.parametrize("lists", [LISTS, LISTS[:1], ([],)])
def test_rules(spark, salted, lists):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[3], "x"), (3, URLS[3], "y")], "page_id long, url string, host string").withColumnsRenamed({"host": "digest"})
    got = U.judged(pages, U.rules(spark, *lists), salted=salted).collect()
    want = [(r["page_id"], *brute(r["url"], lists)) for r in pages.collect()]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert U.judged(pages.limit(0), U.rules(spark, *lists), salted=salted).count() == 0


def test_a_shared_prefix_is_no_match(spark, monkeypatch):
    """With prefixes of no length every rule meets every expression; the digests decide."""
    monkeypatch.setattr(U, "PREFIX", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = U.judged(pages, U.rules(spark, *LISTS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(u, LISTS)) for i, u in enumerate(URLS)), key=str)


def test_pages(spark):
    got = U.op11_url_filter(spark, "/root/testdata/sf0.001").collect()
    urls = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    want = []
    for r in urls:
        h, p, rule, k, v = brute(r["url"], (U.BASE_RULES, U.OWN_RULES))
        want.append((r["page_id"], h, p, rule if k == 0 else None, v))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
