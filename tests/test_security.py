"""Header snapshots on known JSON; the queries against their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.operators import security
from webloom.plans.security_oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(security.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = security.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    want = sorted(map(repr, expected.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert len(want) and sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def test_snapshots(spark):
    texts = ['{"Strict-Transport-Security": "max-age=1", "X-FRAME-OPTIONS": ["DENY", 3, "SAMEORIGIN"], "referrer-policy": "  ", "x-xss-protection": 5, "Other": "permissions-policy"}', '{"x-frame-options": "a", "X-Frame-Options": "b"}', "[1]", "{", "", None, "{}"]
    df = spark.createDataFrame([(k, f"u{min(k, 1)}", t) for k, t in enumerate(texts)], "fetch_seq long, url string, headers_json string")
    rows = {r.fetch_seq: r for r in security.security_rows(df).collect()}
    first = {k: (v.present, v.value) for k, v in rows[0].headers.items()}
    assert first["strict-transport-security"] == (True, "max-age=1") and first["x-frame-options"] == (True, "DENY, SAMEORIGIN") and first["referrer-policy"] == (False, "  ")
    assert first["x-xss-protection"] == first["content-security-policy"] == (False, "") and len(first) == 7
    assert (rows[0].n_present, rows[0].missing_count) == (2, 2)  # names count wherever they stand in the text
    assert rows[1].n_present == 1 and all(rows[k].n_present == 0 and rows[k].missing_count == 7 for k in range(2, 7))
    assert security.security_figures(df).first().asDict() == {"rows": 2, "headers_present": 2, "headers_missing": 12, "pages_with_issues": 2}
    held = df.select("fetch_seq", security.header_map(F.col("headers_json"), ("other",)).alias("h")).collect()
    assert {r.fetch_seq: r.h for r in held} == {0: {"other": "permissions-policy"}, 1: {}, 2: None, 3: None, 4: None, 5: None, 6: {}}
    assert [r.fetch_seq for r in security.ordered_security(security.security_rows(df), "missing").limit(2).collect()] == [0, 1]
