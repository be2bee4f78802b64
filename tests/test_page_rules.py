"""HTML extraction against known pages; rules flip one fact of a clean page at a time."""

import pytest
from pyspark.sql import functions as F

from webloom.functions.html import SCHEMA, extract, parse_html
from webloom.operators.page_rules import detect, header_rules

URL = "https://example.com/page"
WORDS = " ".join(f"word{k}" for k in range(220))
CLEAN = f"""<!DOCTYPE html><html><head><title>A title that is just about as long as it should be</title>
<meta name="description" content="{'d' * 100}"><link rel="canonical" href="{URL}"><link rel="icon" href="/i.png">
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i">
<meta property="og:url" content="{URL}"><meta property="og:type" content="website"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{{"@type": "Article", "author": {{"@type": "Person"}}, "headline": "h", "datePublished": "2024-01-01", "image": "i",
"dateModified": "2024-01-02", "publisher": "p", "mainEntityOfPage": "{URL}"}}</script></head>
<body><h1>Heading</h1><h2>Second</h2><p>{WORDS}</p><img src="/a.png" alt="a" width="1" height="1"><a href="/x">a good name</a></body></html>"""


def issues(spark, html, url=URL):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return sorted(r.issue_type for r in detect(extract(pages)).collect())


def test_fields():
    p = parse_html(CLEAN, URL)
    assert p["title"].startswith("A title") and p["title_count"] == 1 and p["h1"] == ["Heading"] and p["first_heading_level"] == 1
    assert p["jsonld_types"] == ["Article", "Person"] and not p["jsonld_malformed"]
    assert p["links"] == [{"url": "https://example.com/x", "text": "a good name", "rel": "", "target": ""}]
    assert p["word_count"] == 225 and p["canonical_raw"] == URL and p["image_count"] == 1


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<a href='http://[x'>y", "<h1>never closed", "<script>if (a < b) {", "\ud800<p>x"])
def test_broken_documents(html):
    p = parse_html(html, URL)
    assert p["title"] == "" and p["canonical_count"] == 0


def test_clean_page(spark):
    assert issues(spark, CLEAN) == []


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("<title>A title that is just about as long as it should be</title>", "", "missing_title"),
        ("<h1>Heading</h1>", "<h1>Heading</h1><h1>Other</h1>", "multiple_h1"),
        ("<h1>Heading</h1>", f"<h1>{'h' * 71}</h1>", "h1_too_long"),
        ('alt="a"', "", "missing_alt_attribute"),
        ('alt="a"', 'alt=" "', "empty_alt_attribute"),
        (' width="1" height="1"', "", "missing_image_size_attributes"),
        ("a good name", " Click Here ", "non_descriptive_anchor_text"),
        ('<a href="/x">', '<a rel="nofollow" href="/x">', "internal_nofollow_outlink"),
        ('<a href="/x">', '<a target="_blank" href="https://other.org/">', "unsafe_cross_origin_links"),
        ('content="summary"', 'content="poster"', "invalid_twitter_card_type"),
        ('{"@type": "Article"', '{"@type" "Article"', "malformed_structured_data"),
        ('"headline": "h"', '"headline": ""', "invalid_structured_data"),
        ('"publisher": "p"', '"publisher": null', "incomplete_structured_data"),
        ("word7 ", "lorem ipsum ", "lorem_ipsum_detected"),
        ("<h1>", '<form action="http://e.com/"></form><h1>', "form_on_http"),
        ("<h2>Second</h2>", "", "missing_h2"),
        ('rel="canonical" href="https://example.com/page"', 'rel="canonical" href="/page"', "canonical_is_relative"),
    ],
)
def test_one_change(spark, old, new, want):
    assert old in CLEAN
    assert want in issues(spark, CLEAN.replace(old, new))


def test_hreflang(spark):
    links = '<link rel="alternate" hreflang="xq" href="/q"><link rel="alternate" hreflang="en-GB" href="/page/">'
    assert issues(spark, CLEAN.replace("</head>", links + "</head>")) == ["hreflang_invalid_language_code", "hreflang_missing_x_default"]


def test_headers(spark):
    rows = [(1, URL, "noindex", {"x-robots-tag": "index", "referrer-policy": "unsafe-url"}), (2, URL, "", None)]
    df = spark.createDataFrame(rows, "url_id long, url string, meta_robots string, h map<string,string>")
    found = detect(df, header_rules(F.col("h"), F.col("url"), F.col("meta_robots"))).collect()
    assert {r.url_id for r in found} == {1} and len(found) == 6


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(none).count() == 0 and extract(none).schema == spark.createDataFrame([], SCHEMA).schema
