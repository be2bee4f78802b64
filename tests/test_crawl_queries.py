"""Every crawl query against its DuckDB form on the small tables; URL expressions against tables of cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import crawl
from webloom.operators.crawl import QUERIES, recomputed_depths
from webloom.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (urls.sitemap_key, "HTTPS://www.Example.com/a//", "example.com/a"),
        (urls.sitemap_key, "http://example.com/a?b=1", "example.com/a?b=1"),
        (urls.host, "https://Blog.Example.com:8080/x", "blog.example.com"),
        (urls.host, "/relative", ""),
        (urls.frontier_key, "https://e.com/p?utm_source=x&b=2&a=1#top", "https://e.com/p?b=2&a=1"),
        (urls.frontier_key, "https://e.com/p?gclid=9", "https://e.com/p"),
        (urls.repeats_segment, "https://e.com/a/a/a/b", True),
        (urls.repeats_segment, "https://e.com/a/b/a/b", False),
        (urls.repeats_segment, "https://e.com/a/a/b", False),
        (urls.repetitive_path, "https://e.com/a/a/b", True),
        (urls.repetitive_path, "https://e.com/b/a/a", True),
        (urls.repetitive_path, "https://e.com/a/a/a/b", True),
        (urls.repetitive_path, "https://e.com/a//a", False),
        (urls.repetitive_path, "https://e.com/a/ab/b", False),
        (urls.repetitive_path, "https://e.com/a?x=/b/b", False),
        (urls.contains_space, "https://e.com/a%20b", True),
        (urls.contains_space, "https://e.com/a?q=b+c", True),
        (urls.contains_space, "https://e.com/a?q=b#c+d", False),
    ],
)
def test_url_expressions(spark, function, value, want):
    assert spark.range(1).select(function(F.lit(value))).first()[0] == want


def test_url_rules_on_known_urls(spark, tmp_path):
    rows = [(0, "https://e.com/a/a/b"), (1, "https://e.com/a%20b"), (2, "https://e.com/a/b/a")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in QUERIES["url_rules"](spark, str(tmp_path)).collect()} == {(0, "url_repetitive_path"), (1, "url_contains_space")}


def test_page_depths(spark):
    """The nearest seed counts, links and seeds off the crawl don't, and pages that no seed reaches keep their depth; page 0 needn't be there."""
    pages = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (5, 9), (6, 7), (7, 5)], "url_id long, depth long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 4), (4, 1), (6, 7), (1, 50), (50, 6), (60, 7)], "source_id long, target_id long")
    seeds = spark.createDataFrame([(1,), (5,), (60,)], "url_id long")
    assert {tuple(r) for r in recomputed_depths(spark, pages, links, seeds).collect()} == {(1, 0), (2, 1), (3, 2), (4, 1), (5, 0), (6, 7), (7, 5)}
    assert {tuple(r) for r in recomputed_depths(spark, pages, links, seeds.limit(0)).collect()} == {tuple(r) for r in pages.collect()}


def test_hosts_without_https(spark):
    """Only a redirect from the host's own http URLs to https counts, not an https URL of the host."""
    urls_ = spark.createDataFrame([("http://a.com/x", "a.com"), ("https://a.com/x", "a.com"), ("http://b.com/", "b.com"), ("http://c.com/", "c.com"), ("http://d.com/", "d.com"), ("https://e.com/", "e.com"), ("http://f.com/", "f.com")], "url string, host string")
    hops = spark.createDataFrame([("http://b.com/old", "https://b.com/new"), ("http://c.com:8080/", "HTTPS://other.com/"), ("https://a.com/x", "https://a.com/y"), ("http://d.com/", "http://d.com/z"), ("http://f.com.evil.com/", "https://f.com/")], "from_url string, to_url string")
    assert {r.host for r in crawl.hosts_without_https(urls_, hops).collect()} == {"a.com", "d.com", "f.com"}


def test_js_only_links(spark):
    urls_ = spark.createDataFrame([(1, "https://e.com/a"), (2, "https://e.com/b"), (3, "https://e.com/c#x"), (4, "HTTPS://E.com:443/a")], "url_id long, url string")
    links = spark.createDataFrame([(1, 2, "browser"), (1, 2, "browser"), (2, 1, "browser"), (2, 1, "static"), (1, 3, "browser"), (1, 4, "browser"), (1, 1, "browser"), (2, 4, "browser")], "source_id long, target_id long, discovery_mode string")
    assert {tuple(r) for r in crawl.js_only_links(links, urls_).collect()} == {(1, 2), (2, 4)}


def test_copies_read_documents_once(spark):
    """Before, each use of a page's values took its document apart anew: several times a query, ten scans in the table of issues."""
    plan = crawl.duplicate_content(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and "sha2" not in plan
    rows = [(1, 10, "a", "x"), (2, 11, "a", ""), (3, 9, "a", "y"), (4, 5, None, "x")]
    values = spark.createDataFrame(rows, "url_id long, fetch_seq long, title string, h1 string")
    got = {tuple(r) for r in crawl.later_copies(values, {"t": "title", "h": "h1"}).collect()}
    assert got == {("t", 1, "a", 3), ("t", 2, "a", 3), ("h", 1, "x", 2)}
