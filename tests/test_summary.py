"""The summary's figures and robots decisions on known tables; their queries against SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.operators import robots, summary
from webloom.plans.summary_oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(summary.QUERIES | robots.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = (summary.QUERIES | robots.QUERIES)[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert len(want) and sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def tables(spark):
    pages = spark.createDataFrame([(1, "https://e.com/a", 0, "indexable", 100, True), (2, "https://e.com/b/", 1, "", 300, False), (3, "https://e.com/c", 1, None, None, False)], "url_id long, url string, depth int, indexability_state string, word_count long, has_structured_data boolean")
    urls = spark.createDataFrame([(k, f"https://e.com/{x}") for k, x in enumerate("xabcd")], "url_id long, url string")
    fetches = spark.createDataFrame([(200, 10, 0), (200, 20, 5), (404, 30, 6), (None, None, 10), (200, 40, 7)], "status_code int, ttfb_ms long, s int").withColumn("fetched_at", F.timestamp_seconds("s"))
    issues = spark.createDataFrame([(1, "a", "error"), (1, "a", "error"), (2, "b", "info"), (4, "b", "info"), (None, "c", "info"), (9, "d", "info")], "url_id long, issue_type string, severity string")
    sitemap = spark.createDataFrame([("e.com/b",), ("e.com/b",), ("e.com/z",)], "key string")
    return pages, urls, fetches, issues, sitemap, spark.createDataFrame([(2,), (2,), (7,)], "target_id long"), spark.createDataFrame([(3,), (2,)], "member_count long")


def test_figures(spark):
    r = summary.summarise(*tables(spark)).first().asDict(recursive=True)
    assert r["top_issues"] == [{"type": "a", "count": 2, "example_url": "https://e.com/a"}, {"type": "b", "count": 2, "example_url": "https://e.com/b"}, {"type": "c", "count": 1, "example_url": ""}, {"type": "d", "count": 1, "example_url": ""}]
    del r["top_issues"]
    assert r == {
        "total_pages": 3, "total_urls": 5, "total_issues": 6, "issues_by_type": {"a": 2, "b": 2, "c": 1, "d": 1}, "issues_by_severity": {"error": 2, "info": 4}, "indexability_distribution": {"indexable": 1, "unknown": 2},
        "status_code_distribution": {200: 3, 404: 1}, "depth_distribution": {0: 1, 1: 2}, "avg_ttfb": 25.0, "median_ttfb": 30.0, "p95_ttfb": 40.0, "avg_word_count": 200.0, "pages_with_structured_data": 1, "pages_with_issues": 2,
        "pages_in_sitemap": 1, "orphan_page_count": 2, "duplicate_content_count": 5, "thin_content_count": 1, "crawl_duration": 10.0, "pages_per_second": 0.3,
    }


def test_empty_crawl(spark):
    r = summary.summarise(*[df.limit(0) for df in tables(spark)]).first().asDict(recursive=True)
    assert len(r) == 21 and not any(r.values())


FILE = """User-agent: *
Disallow: /private/
Allow: /private/open
Disallow: /*.pdf$
Disallow: /tmp*$
Disallow: /same
Allow: /same
Crawl-delay: 3
User-agent: MyBot
User-agent: Other
Disallow: /bots
crawl-delay: x
User-agent: bot
Disallow: /a*b*c
User-agent: free
Disallow:
Allow
nonsense
"""
CASES = [
    ("Any", "/", True), ("Any", "/private/", False), ("Any", "/private/open/x", True), ("Any", "/x.pdf", False), ("Any", "/x.pdf?y", True), ("Any", "/x.pdf/y.pdf", True), ("Any", "/tmp", False), ("Any", "/tmp/more", False), ("Any", "/same/x", True),
    ("mybot", "/bots/x", False), ("MYBOT", "/private/", True), ("other", "/bots", False), ("Great MyBot/2", "/bots", False), ("robot", "/bots", True), ("robot", "/a-b-c", False), ("robot", "/a-c-b", True), ("robot", "/abxc", False), ("free", "/private/", True), ("", "/private/", False),
]


def test_robots(spark):
    agents = robots.robots_agents(spark.createDataFrame([("h", FILE.replace("\n", "\r\n")), ("none", "# nothing\n\n"), ("lost", "Disallow: /\n")], "host string, text string"))
    paths = spark.createDataFrame([("h", *c) for c in CASES] + [(h, "Any", "/private/", True) for h in ("none", "lost", "absent")], "host string, user_agent string, path string, want boolean")
    groups = robots.chosen_group(agents, paths)
    got = robots.robots_decisions(paths, groups)
    assert got.count() == len(CASES) + 3 and got.where("allowed != want").collect() == []
    delays = {(r.user_agent, r.agent): r.crawl_delay for r in groups.collect()}
    assert delays[("Any", "*")] == 3 and delays[("Great MyBot/2", "mybot")] == 0 and delays[("robot", "bot")] == 0
    assert {r.agent: len(r.rules) for r in agents.collect()} == {"*": 6, "mybot": 1, "other": 1, "bot": 1, "free": 0}
