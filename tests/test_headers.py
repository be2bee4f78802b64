"""Link headers, content signals, Retry-After and durations on known values."""

import datetime

import pytest
from pyspark.sql import functions as F
from webloom.functions import headers


def _one(spark, values, column):
    return spark.createDataFrame([values], ", ".join(f"c{i} {'timestamp' if isinstance(v, datetime.datetime) else 'string'}" for i, v in enumerate(values))).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("header", "want"),
    [
        (None, []),
        ("", []),
        ("x, <>; rel=a", []),
        ("</a>", [("/a", [], [])]),
        ('</a>;REL="Next  PREV" ; title="a, b;c=d"; flag', [("/a", [("rel", "Next  PREV"), ("title", "a, b"), ("c", "d")], ["next", "prev"])]),
        ('</a>; rel=one; rel="two", </b>; rel=x', [("/a", [("rel", "one"), ("rel", "two")], ["one", "two"]), ("/b", [("rel", "x")], ["x"])]),
        ('</a>; title="open, </b>; rel=x', [("/a", [("title", "open, </b>"), ("rel", "x")], ["x"])]),
    ],
)
def test_link_relations(spark, header, want):
    got = _one(spark, [header], headers.link_relations(F.col("c0")))
    assert [(r.uri, [tuple(p) for p in r.params], r.rels) for r in got] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("User-agent: *\nAllow: /a=b", []),
        ("CONTENT-SIGNAL : Search = Yes ,ai-input=no, bad,=,a=b=c # d=e", [("search", "yes"), ("ai-input", "no"), ("", ""), ("a", "b=c")]),
        ("#Content-Signal: a=b\nContent-Signal: a=b\r\nContent-Signal: a=b", [("a", "b"), ("a", "b")]),
    ],
)
def test_content_signals(spark, text, want):
    assert [tuple(s) for s in _one(spark, [text], headers.content_signals(F.col("c0")))] == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, 0), ("", 0), ("0", 0), ("-5", 0), ("+7", 7000), ("120", 120000), (" 5", 0), ("1.5", 0),
        ("Mon, 01 Jan 2024 00:01:30 GMT", 90000), ("Sun, 31 Dec 2023 23:59:00 GMT", 0), ("Monday, 01-Jan-24 00:00:10 UTC", 10000), ("Sunday, 01-Jan-70 00:00:10 GMT", 0),
        ("Mon, 31 Feb 2024 00:01:30 GMT", 0), ("Mon, 01 Jan 2024 99:01:30 GMT", 0), ("Mon, 1 Jan 2024 00:01:30 GMT", 0), ("Xyz, 01 Jan 2024 00:01:30 GMT", 0),
    ],
)
def test_retry_after(spark, value, want):
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    assert _one(spark, [value, now], headers.retry_after_ms(F.col("c0"), F.col("c1"))) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, None), ("", None), ("d", None), ("1 h", None), ("30d", 30 * 86400 * 10**6), ("1.5d", None), ("0", 0), ("-0", 0), ("2h30m", 9000 * 10**6), ("-1.5s", -1500000), (".5ms", 500), ("1500ns", 2), ("3µs4us", 7), ("1h2", None), ("+1m", 60 * 10**6)],
)
def test_duration(spark, value, want):
    assert _one(spark, [value], headers.duration_us(F.col("c0"))) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("999999d", 999_999 * 86400 * 10**6), ("1000000d", 10**6 * 86400 * 10**6), ("106751991d", 106_751_991 * 86400 * 10**6), ("106751992d", None), ("9" * 30 + "d", None)],
)
def test_long_duration(spark, value, want):
    assert _one(spark, [value], headers.duration_us(F.col("c0"))) == want
