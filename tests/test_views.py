"""Every view query against its DuckDB form; robots rules and status families against tables of cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.operators import views
from webloom.plans.view_oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(views.QUERIES))
def test_matches_sql(spark, duck, name):
    df = views.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


ROBOTS = "Disallow: /early\nUser-agent: A\nuser-agent: *  # both\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\n\nUser-agent: B\nDisallow: /"


def test_robots(spark):
    texts = spark.createDataFrame([("h", ROBOTS), ("none", None)], "host string, text string")
    rules = views.robots_rules(texts)
    got = sorted(tuple(r) for r in rules.where("path_pattern != ''").collect())
    assert ("h", "b", "disallow", "/") in got and ("h", "a", "allow", "/private/open") in got
    assert not [r for r in got if r[3] == "/early"] and len(got) == 7
    cases = {"/": True, "/private/x": False, "/private/open": True, "/a.pdf": False, "/a.pdf?x": True, "/a+b": True}
    paths = spark.createDataFrame([("h", p) for p in cases] + [("other", "/private/x")], "host string, path string")
    allowed = views.robots_allowed(paths, rules.where("user_agent = '*'"))
    assert {(r.host, r.path): r.allowed for r in allowed.collect()} == {("h", p): v for p, v in cases.items()} | {("other", "/private/x"): True}


def test_status_family(spark):
    assert spark.range(1).select(views.status_family(F.lit(404), "all"), views.status_family(F.lit(404), "2xx")).first()[:] == (True, False)
    with pytest.raises(KeyError):
        views.status_family(F.lit(404), "6xx")
