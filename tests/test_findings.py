"""Findings and browsing views against their DuckDB form; URL functions, cursors and scope against tables of cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import browse, findings, page_rules
from webloom.plans.finding_oracles import ORACLES

DATA = "/root/testdata/sf0.001"
QUERIES = findings.QUERIES | browse.QUERIES


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
        (urls.normalize, "HTTP://Example.COM:80/a/%7euser/%c3%a9?q=%2f#top", "http://example.com/a/~user/%C3%A9?q=%2F"),
        (urls.normalize, "https://example.com", "https://example.com/"),
        (urls.normalize, "https://example.com:8443/x?a=%7e", "https://example.com:8443/x?a=%7E"),
        (urls.normalize, "mailto:a@b.c", None),
        (urls.normalize, "/only/a/path", None),
        (urls.normalize, "ftp://example.com/x", None),
        (urls.identity, "https://www.example.com/a//?q=1", "https://example.com/a?q=1"),
        (urls.identity, "https://www.example.com", "https://example.com/"),
        (urls.dropped_scheme, "JavaScript:void(0)", True),
        (urls.dropped_scheme, "https://e.com/javascript:", False),
        (urls.decoded_path, "https://e.com/%C3%A9/a+b%20c", "/é/a+b c"),
        (urls.decoded_path, "https://e.com/%zz", "/%zz"),
        (urls.first_segment, "https://e.com//blog/x", "blog"),
        (urls.first_segment, "https://e.com", ""),
    ],
)
def test_url_functions(spark, function, value, want):
    assert spark.range(1).select(function(F.lit(value))).first()[0] == want


def test_ignored_parameters_are_an_argument(spark):
    key = urls.frontier_key(F.lit("https://e.com/p?utm_x=1&sid=3&a=2"), ("sid*",))
    assert spark.range(1).select(key).first()[0] == "https://e.com/p?utm_x=1&a=2"


def test_globs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.glob_match(F.lit("/app/x.html"), "/app/*.html")) and not one(urls.glob_match(F.lit("/app/a/x.html"), "/app/*.html"))


def test_cursors_and_paging():
    assert browse.decode_cursor(browse.encode_cursor(120)) == 120 and browse.decode_cursor("") is None
    with pytest.raises(ValueError):
        browse.decode_cursor("%%%")
    assert [browse.clamp(0, 100, 500), browse.clamp(900, 100, 500), browse.clamp(7, 100, 500)] == [100, 500, 7]
    assert browse.next_offset(0, 50, 120) == 50 and browse.next_offset(100, 20, 120) is None
    assert browse.ignored_filters({"depth": 3, "status": "", "title": "x"}, {"depth"}) == ["title"]


def test_issue_details(spark):
    rows = findings.issues(spark, DATA).where("issue_type = 'canonical_to_redirect'").collect()
    assert rows and all(r.scope == "global" and '"status_code":301' in r.details for r in rows)


def test_heads_and_pictures(spark, tmp_path):
    page = '<html><head><title>t</title><div>x</div></head><head></head><body><body><h1><img src="a.png" alt="Logo"></h1><h1>text <img src="b.png" alt="no"></h1><a href="#part">in page</a><a href="#">top</a></body></html>'
    facts = html.parse_html(page, "https://e.com/")
    assert facts["h1_alt_only"] == ["Logo"] and facts["invalid_in_head"] == ["div"] and (facts["head_count"], facts["body_count"]) == (2, 2)
    assert [x["url"] for x in facts["links"]] == ["https://e.com/#part"]
    spark.createDataFrame([(1, "https://e.com/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.issue_type for r in page_rules.page_rules(spark, str(tmp_path)).collect()}
    assert {"h1_alt_text_only", "invalid_html_in_head", "multiple_head_tags", "multiple_body_tags"} <= found
    assert len(page_rules.LANGUAGES) == 183 and "ae" not in page_rules.LANGUAGES
