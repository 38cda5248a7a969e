"""URL filters against a plain reading of the rules, and against the list itself."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, url_filters

ODD = [
    "http://WWW.Example.COM/en/x?a=1#b", "https://example.com", "https://example.com/en/", "https://notexample.com/en/x", "no scheme", "", None,
    "http://a.net/es/x", "http://a.net/esx", "http://net/fr/", "://x.com/y", "http://a.com?x=/en/", "http://É.com/en/", "http://a.com/p//?utm_source=x",
    "http://a.com/p?ref=z&b=2&a=1#t", "https://www.a.com:443/p?a=1&b=2", "http://x/y://z.com/en/",
]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


@pytest.mark.parametrize("bits, most", [(16, 1 << 18), (0, 1 << 18), (16, 0)])
def test_judge(spark, monkeypatch, bits, most):
    """As it is, with one block (nearly every page is a possible hit), and with a filter too large to be broadcast."""
    monkeypatch.setattr(url_filters, "BITS_PER_URL", bits)
    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", most)
    urls = ODD + [f"http://h{i % 7}.example.org/p{i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, Rule string")
    listed = spark.createDataFrame([(u,) for u in [*urls[::5], "http://a.com/p?a=1&b=2", None]], "url string")
    rows = url_filters.judge(pages, listed, queries.URL_RULES)
    assert rows.columns[:4] == pages.columns and len(set(map(str.lower, rows.columns))) == len(rows.columns)
    canonical = {r[0] for r in listed.select(url_filters.canonical(F.col("url"))).collect()} - {None}
    own = {r[0]: r[1] for r in pages.select("url", url_filters.canonical(F.col("url"))).collect()}
    found = rows.collect()
    assert len(found) == 2 * len(urls)
    for r in found:
        host, path = plain(r["url"])
        rule, verdict = plain_rule(host, path)
        on_list = own[r["url"]] in canonical
        assert (r["_host"], r["path"], r["_Rule" if "_Rule" in r else "_rule"]) == (host, path, rule)
        assert r["listed"] == on_list and (not on_list or r["possible"])
        assert r["verdict"] == (verdict or ("block" if on_list else "allow"))
    if bits == 0:
        assert sum(r["possible"] for r in found) > sum(r["listed"] for r in found)


def test_canonical_forms_agree(spark):
    twins = ["http://a.com/p?ref=z&b=2&a=1#t", "https://www.a.com:443/p?a=1&b=2", "HTTP://A.com/p/?b=2&a=1"]
    rows = spark.createDataFrame([(t,) for t in twins], "url string")
    assert rows.select(url_filters.canonical(F.col("url"))).distinct().count() == 1


def test_long_urls_and_a_common_one(spark):
    long = ["http://a.com/" + "/" * 500_000 + "x", "http://a.com/" + "/" * 500_000, "http://a.com/p?" + "&".join(f"k{i}=v" for i in range(50_000)), "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    many = spark.range(3000).select(F.col("id") + 10, F.lit("https://www.a.com/#top").alias("url")).toDF("page_id", "url")
    listed = spark.createDataFrame([("http://a.com",)] * 20 + [(long[2],)], "url string")
    rows = url_filters.judge(pages.union(many), listed, [])
    assert rows.count() == 3004
    assert {r["page_id"] for r in rows.filter("listed and page_id < 10").collect()} == {1, 2} and rows.filter("listed").count() == 3002


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filters.judge(none, one, queries.URL_RULES).count() == 0
    assert url_filters.judge(one, none, []).first()["verdict"] == "allow"


def test_query(spark, medium):
    rows = queries.op1_url_filters(spark, medium).collect()
    pages = spark.read.parquet(f"{medium}/pages.parquet").select("page_id", "url").collect()
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows}
    for p in pages:
        host, path = plain(p["url"])
        r = by[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, plain_rule(host, path)[0])
