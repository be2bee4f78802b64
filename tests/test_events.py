"""Event details on known JSON: what decodes, what is routed where, scores, audits, violations, means; purges down the tables."""

import json

import pytest
from pyspark.sql import functions as F
from webloom.operators import events, sinks

SCHEMA = "event_id int, event_type string, details_json string"


def _events(spark, rows):
    return events.split_events(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize(("text", "readable"), [(None, False), ("", False), ("{", False), ("nope", False), ("{}", True), ("[]", True), ('"x"', True), ("3", True), ("null", True)])
def test_decoded(spark, text, readable):
    assert spark.createDataFrame([(text,)], "x string").select(events.decoded(F.col("x")).isNotNull().alias("r")).first().r is readable


def test_routes(spark):
    rows = [(1, "psi_audit", "{}"), (2, "psi_audit", "[]"), (3, "axe_audit", None), (4, "metric", "{"), (5, "metric", '{"a":1}'), (6, "phase", "{"), (7, None, None), (8, "markdown_negotiation", '"x"'), (9, "fetch_error", '{"e":"x"}')]
    got = {r.event_id: (r.kind, r.known) for r in _events(spark, rows).select("event_id", "kind", F.col("details").isNotNull().alias("known")).collect()}
    assert got == {1: ("psi", True), 5: ("metric", True), 6: ("event", False), 7: ("event", False), 9: ("event", True)}
    assert _events(spark, []).count() == 0


def test_page_speed_response(spark):
    audits = {"speed-index": {"title": "Speed", "score": 0.5, "numericValue": 1200.5, "displayValue": "1.2 s"}, "first-contentful-paint": {"numericValue": "9"}, "none": {"title": "", "score": 0}, "text": "x", "list": [1], "zero": {"score": None, "title": "Z"}}
    full = {"lighthouseResult": {"categories": {"performance": {"score": 0.9}, "seo": {"score": None}, "best-practices": {}, "accessibility": 3}, "audits": audits}}
    rows = [(1, "psi_audit", json.dumps(full)), (2, "psi_audit", "{}"), (3, "psi_audit", '{"lighthouseResult": 5}'), (4, "psi_audit", '{"lighthouseResult": {"audits": []}}')]
    df = _events(spark, rows)
    scores = {r.event_id: r for r in events.audit_scores(df).collect()}
    assert len(scores) == 4 and (scores[1].performance, scores[1].seo, scores[1].accessibility, scores[1].best_practices, scores[1].si, scores[1].fcp) == (0.9, 0.0, 0.0, 0.0, 1200.5, 0.0)
    assert scores[2].performance == scores[3].si == scores[4].lcp == 0.0
    found = sorted((r.event_id, r.audit, r.title, r.score, r.display_value) for r in events.audit_rows(df).collect())
    assert found == [(1, "speed-index", "Speed", 0.5, "1.2 s"), (1, "zero", "Z", 0.0, "")]


def test_violations(spark):
    rows = [(1, "axe_audit", '{"violations":[{"id":"a","impact":"serious","nodes":[1,2,3]},{"id":"b"},7]}'), (2, "axe_audit", '{"error":"late","violations":[{"id":"a"}]}'), (3, "axe_audit", "{}"), (4, "axe_audit", '{"violations":{}}')]
    got = sorted((r.event_id, r.rule, r.impact, r.n_nodes) for r in events.violations(_events(spark, rows)).collect())
    assert got == [(1, "a", "serious", 3), (1, "b", "", 0)]


def test_means_have_denominators_of_their_own(spark):
    rows = [(1, "psi_audit", '{"performanceScore":0.5,"seo":1}'), (2, "psi_audit", '{"performance":1.0,"best_practices":0.25}'), (3, "psi_audit", '{"seo":"x"}')]
    r = events.audit_means(_events(spark, rows)).first()
    assert (r.total, r.avg_performance, r.avg_accessibility, r.avg_best_practices, r.avg_seo) == (3, 0.75, None, 0.25, 1.0)
    none = events.audit_means(_events(spark, [])).first()
    assert (none.total, none.avg_seo) == (0, None)


def test_purge_cascade(spark):
    make = spark.createDataFrame
    tables = {"job": make([(1, 10), (2, None), (3, 20)], "id int, age int"), "url": make([(1, 1), (2, 2), (3, None), (4, 9), (5, 3)], "id int, job int"), "page": make([(1, 1, 5), (2, 2, 2), (3, 2, 1), (4, None, None)], "id int, url int, final int"), "note": make([(1, 1), (2, 3), (3, 4)], "id int, page int")}
    links = [("url", "job", "job", "id"), ("page", "url", "url", "id"), ("page", "final", "url", "id"), ("note", "page", "page", "id")]
    left = sinks.purge_cascade(tables, links, "job", F.col("age") < 15)
    ids = {name: sorted(r.id for r in df.collect()) for name, df in left.items()}
    assert ids == {"job": [2, 3], "url": [2, 3, 4, 5], "page": [2, 4], "note": [3]}
    assert {n: df.count() for n, df in sinks.purge_cascade(tables, links, "job", F.lit(False)).items()} == {"job": 3, "url": 5, "page": 4, "note": 3}
