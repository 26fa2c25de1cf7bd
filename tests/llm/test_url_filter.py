from __future__ import annotations

import math

from helixframe.llm import queries, url_filter
from helixframe.llm.common import table
from tests.oracle import same

URLS = [
    "http://WWW.Example.COM/en/x", "https://example.com/en/", "https://example.com/EN/", "http://a.b.com/fr", "http://com", "http://com/",
    "http://x.net/es/1?q=://y.com/", "http://net/fr/", "http://fr.net/fr", "http://notcom/", "ftp://host#frag/en/", "no scheme", "", None,
    "http://ex.org/päth/é?x", "://", "http:///path", "http://example.com/en/?a", "http://sub.www.example.com/en/q", "http://www.example.net/es/",
]


def plain(url, rules=url_filter.RULES):
    host, path = url_filter.split_url(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = min(fits, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
        return host, path, best[0] + best[1], best[2]
    w = url_filter.fit()
    z = w[-1] + sum(w[b] * v for b, v in url_filter.features(host, path).items())
    return host, path, None, "block" if round(1 / (1 + math.exp(-z)), 6) > 0.5 else "allow"


def test_query_matches_sql(spark, medium):
    same(queries.op7_url_filters(spark, medium), queries.SQL["op7_url_filters"], medium)


def test_query_matches_plain_python(spark, medium):
    urls = {r.page_id: r.url for r in table(spark, medium, "pages").collect()}
    for r in queries.op7_url_filters(spark, medium).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id])


def test_odd_urls_case_and_join(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    want = {i: plain(u) for i, u in enumerate(URLS)}
    for cases in (url_filter.MAX_CASES, 0):  # as one CASE, and as a join
        monkeypatch.setattr(url_filter, "MAX_CASES", cases)
        got = url_filter.judge(pages).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


def test_training_urls_are_learned(spark):
    pages = spark.createDataFrame(url_filter.LABELLED, "url string, y int")
    got = url_filter.judge(pages, rules=[]).collect()
    assert sum((r.verdict == "block") == bool(r.y) for r in got) >= 0.95 * len(got)
    held = url_filter.fit(url_filter.LABELLED[::2])
    right = 0
    for url, y in url_filter.LABELLED[1::2]:
        z = held[-1] + sum(held[b] * v for b, v in url_filter.features(*url_filter.split_url(url)).items())
        right += (z > 0) == bool(y)
    assert right / 20 >= 0.7


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge(one, rules=[], labelled=[]).first().verdict == "allow"
