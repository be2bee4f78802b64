"""Hard negatives against brute force: ties, repeated rows and ids, nulls, mixed widths, huge components, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.llm import mining


def brute(rows, is_anchor, n_positives=5, n_negatives=3):
    rows = list({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, z) for j, z, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:n_positives]:
            held = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(held)]
    return sorted(out)


def rows_of(kind):
    rnd = random.Random(5)
    vector = lambda n=6, top=9: [rnd.randint(-top, top) for _ in range(n)]
    rows = [(i, rnd.randint(0, 3), vector()) for i in range(120)]
    rows += [(200 + i, i % 3, [5, 5, 5, 1, 0, 2]) for i in range(40)]  # a hot vector, ties everywhere
    rows += [(300, 1, [4, 4]), (301, 2, []), (302, None, vector()), (303, 1, None), (304, 2, [1, None, 3]), (None, 1, vector()), (305, 0, [0] * 6)]
    rows += [rows[0], rows[10], (10, 1, vector()), (10, 2, vector())]  # equal rows, and ids of several rows
    if kind == "huge":
        rows = [(i, y, v if v is None else [None if x is None else x * (1 << 27) for x in v]) for i, y, v in rows[:60]]
    return rows


@pytest.mark.parametrize("kind, block", [("plain", 4096), ("plain", 16), ("huge", 16)])
def test_hard_negatives(spark, monkeypatch, kind, block):
    monkeypatch.setattr(mining, "BLOCK", block)
    rows = rows_of(kind)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, vector array<bigint>, cell string, part int").repartition(3)
    got = mining.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<bigint>")
    assert mining.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1, 2])], "vec_id long, label int, vector array<bigint>")
    assert mining.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0


def test_brackets_hold():
    """The stored distances bracket every score."""
    import numpy as np

    rnd = np.random.default_rng(2)
    x, q = rnd.integers(-300, 300, (200, 16)), rnd.integers(-300, 300, (20, 16))
    longest = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = mining.Pivots(x[:64], longest)
    d = pivots.distances(pivots.stored(x))
    low, high = mining._bracket(pivots.of_queries(q), d, d, (q.astype(float) ** 2).sum(axis=1) + longest)
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
