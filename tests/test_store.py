"""Site files, sinks and streams against their DuckDB form; files, structured data and rate limits against tables of cases."""

import glob
import gzip
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.functions.html import extract, parse_html
from webloom.functions.structured import MOST_RESULTS, validate
from webloom.operators import page_rules, sinks
from webloom.plans.store_oracles import ORACLES
from webloom.sources import site_files
from webloom.streaming import stateful

DATA = "/root/testdata/sf0.001"
QUERIES = site_files.QUERIES | sinks.QUERIES | stateful.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert want and sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def test_rate_limit(spark):
    windows, want = {}, {}
    for user, seq in sorted(((r.user_id, r.event_id) for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id").collect()), key=lambda x: x[1]):
        key = str(user % 10)
        start, n = windows.get(key, (None, 0))
        if start is None or seq - start >= 100:
            start, n = seq, 0
        want[seq] = n < 3
        windows[key] = (start, n + want[seq])
    assert {r.seq: r.allowed for r in stateful.st_rate_limit(spark, DATA).collect()} == want
    assert set(want.values()) == {True, False}


def _index(*names):
    return ("<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>").encode()


def _set(*urls):
    return ("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>").encode()


def test_walk_of_sitemaps(spark):
    files = [("r", _index("a", "b.gz", "r", "missing", "bad")), ("a", _index("c")), ("b.gz", gzip.compress(_set("u1", "u2"))), ("c", _set("u3", "u3")), ("bad", b"<urlset>"), ("apart", _set("u4")), ("none", None)]
    df = spark.createDataFrame(files, "url string, body binary")
    found = site_files.walk_sitemaps(df, df.where("url in ('r', 'none')").select("url"))
    assert sorted((r.sitemap_url, r["loc"]) for r in found.collect()) == [("b.gz", "u1"), ("b.gz", "u2"), ("c", "u3"), ("c", "u3")]
    assert site_files.walk_sitemaps(df.limit(0), df.limit(0).select("url")).count() == 0


@pytest.mark.parametrize(
    ("body", "kind", "n"),
    [(b"", "malformed", 0), (b"<html/>", "malformed", 0), (_index(), "malformed", 0), (_set(), "urlset", 0), (b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- x --><url><loc>u</loc></url></urlset>', "urlset", 1)],
)
def test_kind_of_sitemap(body, kind, n):
    found, entries = site_files.parse_sitemap(body, "s.xml")
    assert (found, len(entries)) == (kind, n)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        (" \n\t", []),
        ("hello", [("", "hello")]),
        ("# A\r\nx\n\n## B ##\n y ", [("A", "x"), ("B ##", "y")]),
        ("\n  #C", [("", ""), ("C", "")]),
        ("#\n#", [("", ""), ("", "")]),
    ],
)
def test_llms_sections(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string").select(site_files.llms_sections(F.col("text")).alias("s"))
    assert [tuple(x) for x in df.first().s] == want


def test_llms_urls(spark):
    df = spark.createDataFrame([("see [x](http://a.example/b), http://a.example/b. https://c.example/?d!",)], "text string")
    assert df.select(site_files.llms_urls(F.col("text")).alias("u")).first().u == ["http://a.example/b", "https://c.example/?d"]


def test_structured_data():
    product = {"@type": "Product", "name": "", "offers": {"@type": ["Offer", "x"], "price": 0}, "review": [{"@type": "Review"}, {"no": 1}]}
    found = validate([json.dumps({"@graph": [product]}), "{", json.dumps([{"@type": "Person"}, 3])])
    assert [(r["type"], r["missing_required"], r["nested"]) for r in found] == [("Product", ["name"], True), ("Offer", ["priceCurrency"], True), ("Review", ["author", "itemReviewed", "reviewRating"], True), ("Person", [], False)]
    assert found[3]["missing_recommended"] == ["image", "jobTitle", "name", "sameAs", "url"]
    assert len(validate([json.dumps([{"@type": "Person"}] * 80)])) == MOST_RESULTS
    page = parse_html('<script type="application/ld+json">{"@type":"FAQPage"}</script>', "http://a.example/")
    assert page["structured"] == [{"type": "FAQPage", "missing_required": ["mainEntity"], "missing_recommended": [], "nested": False}]


def test_sinks_with_nulls(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (None, 7, "c")], "k int, n int, t string")
    rows = spark.createDataFrame([(1, None), (2, 3), (4, 4)], "k int, n int")
    assert {tuple(r) for r in sinks.update_else_insert(table, rows, "k").collect()} == {(1, None, "a"), (2, 3, "b"), (None, 7, "c"), (4, 4, None)}
    other = spark.createDataFrame([(1, 4, "x"), (2, 1, "y")], "k int, n int, t string")
    assert {tuple(r) for r in sinks.keep_richer(table, other, "k", "n", ["t"]).collect()} == {(1, 5, "a"), (2, 1, "y"), (None, 7, "c")}
    jobs = spark.createDataFrame([("running", None, None), (None, None, None)], "status string, finished_at string, error string")
    assert {tuple(r) for r in sinks.reap(jobs, "lost", F.lit("now")).collect()} == {("failed", "now", "lost"), (None, None, None)}


def test_structured_data_rules(spark):
    html = '<script type="application/ld+json">[{"@type":"FAQPage"},{"@type":"Product","name":"x","review":{"@type":"Review"}}]</script>'
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://a.example/b", None)], "page_id long, url string, html string")
    rows = page_rules.detect(extract(pages)).where("issue_type like '%complete_structured_data' or issue_type like 'invalid_structured%'")
    assert sorted((r.url_id, r.issue_type) for r in rows.collect()) == [(1, "incomplete_structured_data"), (1, "invalid_structured_data"), (1, "invalid_structured_data")]
