import re

import pytest
from compare import compare, connect
from lanepulse.llm import bloom, queries, sql, urls
from pyspark.sql import functions as F

RULES = [(verdict, *text.partition("/")[::2]) for verdict, text in urls.RULES]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain(url, listed):
    host, path = parts(url)
    fit = [(len(h) + len(p), f"{h}/{p}", v) for v, h, p in RULES
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if url in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://a.net", "http://a.net/x?y://z", "http://net/en/", "http://example.net/en/1#t",
    "http://b.example.net/en", "http://B.EXAMPLE.NET/en/", "http://xexample.net/en/", "http://example.com/de/", "http://example.com/DE/",
    "http://x.org/fr/", "http://org/fr/?a", "http://org?fr/", "http://é.com/ü#://", "a://b://c/d", "http://bad.com/x/", "http://www.bad.com/x?utm_a=1",
    "http://good.com/x", "http://bad.com:80/x?b=2&a=1", "https://bad.com/x?a=1&b=2#f", "ftp://u@host:21/p\nq?r",
]


def test_parts_rules_and_list(spark):
    listed = spark.createDataFrame([("http://bad.com/x",), ("https://bad.com/x?b=2&a=1",), (None,), ("http://bad.com/x",), ("junk",)], "url string")
    bad = {"http://bad.com/x/", "http://www.bad.com/x?utm_a=1", "http://bad.com:80/x?b=2&a=1", "https://bad.com/x?a=1&b=2#f"}
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(0, None, "mine")], "page_id long, url string, host string")
    for most in (1, bloom.MAX_BLOCKS):  # a full filter changes the work, not the result
        out = urls.judge_urls(pages, listed, max_blocks=most)
        assert out.columns == ["page_id", "url", "host", "path", "canonical", "rule", "verdict"]
        rows = out.collect()
        assert len(rows) == len(URLS) + 1
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, bad), r.url
    assert urls.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0)).where("rule IS NULL").collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_match_sql(spark, sf_dir, name):
    ok, _, why = compare(spark, connect(sf_dir), sf_dir, name, queries.queries()[name], sql.oracle_sql()[name])
    assert ok, why


def test_filter_never_misses_and_mostly_prunes(spark):
    keys = spark.range(2000).select(F.col("id").alias("k"))
    rows = spark.range(20_000).select("id", F.lit(1).alias("x"))
    hits = bloom.with_hits(rows, ["id"], keys, ["k"])
    assert hits.columns == ["id", "x", "_hit"]
    assert hits.where("id < 2000 AND NOT _hit").count() == 0
    assert hits.where("id >= 2000 AND _hit").count() < 400
    assert bloom.block_count(0) == bloom.block_count(16) == 1 and bloom.block_count(10**9) == bloom.MAX_BLOCKS


def test_every_operator_is_registered():
    names = sorted(int(m[1]) for q in queries.queries() if (m := re.match(r"op(\d+)_", q)))
    assert names == list(range(1, 14)) and "pipeline" in queries.queries()


def test_column_names_with_dots_and_very_long_urls(spark):
    long_url = "http://a.net/" + "x" * 200_000
    rows = [(1, "http://a.org/x"), (2, long_url), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, `page.url` string")
    listed = spark.createDataFrame([(long_url.replace("a.net", "b.org"),), ("http://a.org/x",)], "`page.url` string")
    got = {r.page_id: (r.host, len(r.path), r.rule, r.verdict) for r in urls.judge_urls(pages, listed, url="page.url").collect()}
    assert got == {1: ("a.org", 2, None, "block"), 2: ("a.net", 200_001, "net/", "block"), 3: ("", 0, None, "allow")}
