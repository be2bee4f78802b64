"""Clusters of spellings and URL groups on known pages; the queries against their SQL."""

import glob
import os

import duckdb
import pytest

from webloom.operators import variants
from webloom.plans.variant_oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(variants.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = variants.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert len(want) and sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


H = "https://e.com"
PAGES = [
    # page_id, page, requested, final, canonical, content, state, status
    (1, f"{H}/a", "http://e.com/a", f"{H}/a", None, "c1", "indexable", 200),
    (2, f"{H}/b", f"{H}/b", None, f"{H}/b", "c2", "indexable", 200),
    (3, f"{H}/b/", f"{H}/b/", " ", f"{H}/b", "c2", "indexable", 200),
    (4, "https://www.e.com/d", "https://www.e.com/d", "https://www.e.com/d", None, "c4", None, None),
    (5, f"{H}/d", f"{H}/d", f"{H}/d", "", "c4", "indexable", 200),
    (6, f"{H}/f?x=1", f"{H}/f?x=1", f"{H}/f?x=1", None, "c6", "indexable", 200),
    (7, f"{H}/f/?x=1", f"{H}/f/?x=1", f"{H}/f?x=1", None, "c7", "indexable", 200),
    (8, "not a url/", "not a url/", None, None, "", "indexable", 404),
    (9, f"{H}/b", f"{H}/b", f"{H}/z", f"{H}/b", None, "indexable", 301),
]
SCHEMA = "page_id long, page_url string, requested_url string, final_url string, canonical_url string, content_hash string, indexability_state string, status_code int"


def test_clusters(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    got = {r.page_key: (r.primary_url, r.canonical_url, r.content_hash, r.variant_count, r.page_count, r.cluster_type, r.issue_severity) for r in variants.url_clusters(pages).collect()}
    assert got == {
        f"{H}/a": (f"{H}/a", None, "c1", 2, 1, "redirect_consolidated", None),
        f"{H}/b": (f"{H}/b", f"{H}/b", "c2", 6, 2, "canonicalized_duplicate", "info"),
        f"{H}/d": ("https://www.e.com/d", None, "c4", 4, 2, "duplicate_content_variant", "warning"),
        f"{H}/f?x=1": (f"{H}/f?x=1", None, "c6", 3, 2, "distinct_content", None),
        "not a url": ("not a url/", None, None, 2, 1, "redirect_consolidated", None),
    }
    spellings = {(r.kind, r.url): (r.page_id, r.status_code) for r in variants.url_spellings(pages).where(f"page_key = '{H}/b'").collect()}
    assert spellings == {("requested", f"{H}/b"): (2, 200), ("requested", f"{H}/b/"): (3, 200), ("final", f"{H}/b"): (2, 200), ("final", f"{H}/b/"): (3, 200), ("final", f"{H}/z"): (9, 301), ("canonical", f"{H}/b"): (2, 200)}
    assert [r.page_key for r in variants.ordered_clusters(variants.url_clusters(pages), 3).collect()] == [f"{H}/b", f"{H}/d", f"{H}/f?x=1"]
    assert variants.url_clusters(pages.limit(0)).count() == 0


def test_groups(spark):
    paths = [f"/blog/{k}" for k in range(12)] + [f"/shop/item-{k}/x" for k in range(10)] + [f"/few/{k}" for k in range(9)] + ["", "/", "/blogroll", "/blog", "/docs/a/b", "/docs", "/docsy/a", "/api/v1/x", "/%62log/enc"]
    paths += [f"/docs/p{k}" for k in range(10)]
    urls = spark.createDataFrame([(k, f"https://e.com{p}") for k, p in enumerate(paths)], "url_id long, url string")
    groups = [("articles", "/blog/[1-3]*"), ("documents", "/docs"), ("v1", "/api/*/x"), ("first", "/blog/1")]
    got = {r.url[len("https://e.com") :]: (r.url_group, r.group_source) for r in variants.grouped_urls(urls, groups).collect()}
    assert len(got) == len(paths)
    assert got["/blog/0"] == (None, None)  # /blog is spoken for by /blog/[1-3]*
    assert got["/blog/1"] == ("first", "user") and got["/blog/11"] == got["/blog/2"] == ("articles", "user") and got["/blog/4"] == (None, None)
    assert got["/shop/item-3/x"] == ("shop", "auto") and got["/few/1"] == got[""] == got["/"] == got["/docsy/a"] == (None, None)
    assert got["/docs/a/b"] == got["/docs"] == got["/docs/p1"] == ("documents", "user") and got["/api/v1/x"] == ("v1", "user")
    free = {r.url[len("https://e.com") :]: r.url_group for r in variants.grouped_urls(urls, []).collect()}
    assert free["/blog/0"] == free["/blog"] == free["/%62log/enc"] == "blog" and free["/docs"] == "docs" and free["/few/1"] is None
