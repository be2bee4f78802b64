"""Hard negatives from a pivot table: stored distances to pivots bracket every score, only survivors are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Pivots, the rows they are chosen from, and candidates in a block.
PIVOTS, PIVOT_SAMPLE, BLOCK = 16, 512, 4096
_SLICE = 128
_LONG = 2**63 - 1


def _matrix(column) -> np.ndarray:
    """Vectors of integers as rows, the shorter ones filled with zeros."""
    out = np.zeros((len(column), max((len(v) for v in column), default=0)), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _alike(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices with as many columns as the widest."""
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]


class Pivots:
    """Pivots among augmented vectors, in which inner products are distances.

    With M at least every norm, a stored vector x gets one more coordinate, sqrt(M^2 - |x|^2), and a
    query q gets a zero, so |q' - x'|^2 = |q|^2 + M^2 - 2<q, x>: the larger the product, the nearer.
    """

    def __init__(self, sample: np.ndarray, longest: float, n: int = PIVOTS):
        self.longest = longest
        points = self.stored(sample)
        chosen, far = [], np.full(len(points), np.inf)
        for _ in range(min(n, len(points))):  # each as far as can be from those before it
            at = int(np.argmax(far))
            if chosen and far[at] <= 0:
                break
            chosen.append(at)
            far = np.minimum(far, ((points - points[at]) ** 2).sum(axis=1))
        self.points = points[chosen]

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate((np.sqrt(np.maximum(self.longest - (x**2).sum(axis=1), 0))[:, None], x), axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        points, own = _alike(points, self.points)
        squares = (points**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :] - 2 * points @ own.T
        return np.sqrt(np.maximum(squares, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate((np.zeros((len(q), 1)), q.astype(float)), axis=1))


def _bracket(dq: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score of queries (rows) with candidates or groups of them (columns) by the triangle inequality.

    ``nearest`` and ``farthest`` are the columns' least and greatest distances to each pivot; ``base`` is
    |q|^2 + M^2. The bounds are widened by what rounding can take.
    """
    low, high = np.zeros((len(dq), len(nearest))), np.full((len(dq), len(nearest)), np.inf)
    for p in range(dq.shape[1]):
        np.maximum(low, dq[:, p, None] - farthest[None, :, p], out=low)
        np.maximum(low, nearest[None, :, p] - dq[:, p, None], out=low)
        np.minimum(high, dq[:, p, None] + farthest[None, :, p], out=high)
    slack = 1e-6 * base[:, None] + 1e-6
    return (base[:, None] - high**2) / 2 - slack, (base[:, None] - low**2) / 2 + slack


def _exact(q: np.ndarray, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products of the wanted pairs; others are not looked at. Python's integers where doubles could round."""
    most = max(1, q.shape[1]) * max(1, *(int(abs(int(f(x, initial=0)))) for x in (q, c) for f in (np.max, np.min))) ** 2
    if most >= 2**53:
        out = np.zeros(wanted.shape, object)
        for i, j in zip(*np.nonzero(wanted), strict=True):
            out[i, j] = sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True))
        return out
    if wanted.mean() > 0.05:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    out = np.zeros(wanted.shape, np.int64)
    i, j = np.nonzero(wanted)
    out[i, j] = np.einsum("ij,ij->i", q[i], c[j])
    return out


def _first(score: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest kept scores, ties to the smaller id."""
    i, j = np.nonzero(keep)
    if len(i) > 4 * k * len(keep):  # most kept entries lie under each row's k-th best
        shown = np.where(keep, score.astype(float), -np.inf)
        bar = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k] if shown.shape[1] > k else np.full(len(shown), -np.inf)
        i, j = np.nonzero(keep & (shown >= bar[:, None]))
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best]


class _Block:
    """Candidates of a block and the anchors that were sent to it, as arrays."""

    def __init__(self, asked: pd.DataFrame, dealt: pd.DataFrame, longest: float):
        self.q, self.c = _alike(_matrix(asked["v"]), _matrix(dealt["v"]))
        self.qid, self.cid = asked["id"].to_numpy(), dealt["id"].to_numpy()
        self.q_label, self.c_label = asked["label"].to_numpy(), dealt["label"].to_numpy()
        self.dq = np.array(asked["seen_from"].tolist(), float).reshape(len(asked), -1)
        self.dc = np.array(dealt["distances"].tolist(), float).reshape(len(dealt), -1)
        self.base = (self.q.astype(float) ** 2).sum(axis=1) + longest

    def bounds(self, rows, cols) -> tuple[np.ndarray, np.ndarray]:
        return _bracket(self.dq[rows], self.dc[cols], self.dc[cols], self.base[rows])


def _positives(block: _Block, bars: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor, candidate, score) of each anchor's k best candidates of its own label, if they reach its bar."""
    for label in np.unique(block.q_label):
        asked, cols = np.flatnonzero(block.q_label == label), np.flatnonzero(block.c_label == label)
        for at in range(0, len(asked) if len(cols) else 0, _SLICE):
            rows = asked[at : at + _SLICE]
            other = block.qid[rows][:, None] != block.cid[cols][None, :]
            low, high = block.bounds(rows, cols)
            low[~other] = -np.inf
            bar = bars[rows]
            if len(cols) > k:  # the k-th best lower bound is reached by k candidates
                bar = np.maximum(bar, np.partition(low, len(cols) - k, axis=1)[:, len(cols) - k])
            keep = other & (high >= bar[:, None])
            score = _exact(block.q[rows], block.c[cols], keep)
            for i, j in zip(*_first(score, block.cid[cols], keep, k), strict=True):
                yield int(rows[i]), int(cols[j]), int(score[i, j])


def _negatives(block: _Block, wanted: list[np.ndarray], k: int, low_pct: int, high_pct: int) -> Iterator[tuple]:
    """(anchor, place of the positive, candidate, score) of each positive's k best candidates of other labels inside its band."""
    cols = np.arange(len(block.cid))
    for at in range(0, len(block.qid), _SLICE):
        rows = np.arange(at, min(at + _SLICE, len(block.qid)))
        asked = [[int(s) for s in wanted[r]] for r in rows]
        lowest = np.array([min((low_pct * s for s in a if s >= 0), default=np.inf) / 100 for a in asked])
        highest = np.array([max((high_pct * s for s in a if s >= 0), default=-np.inf) / 100 for a in asked])
        low, high = block.bounds(rows, cols)
        keep = (block.qid[rows][:, None] != block.cid[None, :]) & (block.q_label[rows][:, None] != block.c_label[None, :])
        keep &= (high >= lowest[:, None]) & (low <= highest[:, None])
        if not keep.any():
            continue
        score = _exact(block.q[rows], block.c, keep)
        for place in range(max(map(len, asked))):
            # least and greatest score that a negative of this positive may have: bounds of 100 * score, rounded inwards
            least = np.array([-(-low_pct * a[place] // 100) if place < len(a) else 1 for a in asked], score.dtype)
            most = np.array([high_pct * a[place] // 100 if place < len(a) else 0 for a in asked], score.dtype)
            held = keep & (score >= least[:, None]) & (score <= most[:, None])
            for i, j in zip(*_first(score, block.cid, held.astype(bool), k), strict=True):
                yield int(rows[i]), place, int(j), int(score[i, j])


def hard_negatives(
    vectors: DataFrame, anchors, n_positives: int = 5, n_negatives: int = 3, low_pct: int = 50, high_pct: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector"
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels inside a band of that score.

    ``vectors`` has arrays of integers, ``anchors`` is a condition on it. Scores are inner products;
    higher ones come first, ties go to the smaller id. A negative of a positive of score p has a
    score s with low_pct * p <= 100 * s <= high_pct * p.

    Every row's distances to PIVOTS pivots are computed once and stored; pivots are chosen far apart
    among PIVOT_SAMPLE rows. By the triangle inequality they bracket each score, for a whole cell of
    rows (those nearest to one pivot) before an anchor is sent there, then for each row; rows
    whose bracket can reach neither the k best nor the band are dropped, and all others are scored
    exactly. Cells are cut into blocks of about BLOCK rows, so a hot vector is many blocks' work. An
    anchor first meets its own block, and the bar found there keeps it out of cells below it.

    Rows with a null id, label or vector, or a null in the vector, take no part. Rows equal in id,
    label and vector count once; rows that share only the id are rows of their own, but none is a
    positive or negative of its own id. Shorter vectors count as if filled with zeros. Scores are held
    to the range of a long. An empty table gives an empty result; other columns are ignored.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    v, label = F.col(vector_col), F.col(label_col)
    usable = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    picked = usable.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<bigint>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = stash(picked.withColumn("key", F.xxhash64("id", "label", "v")).dropDuplicates(["id", "label", "key"]), "mining-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = rows.select("v", "key").orderBy("key").limit(PIVOT_SAMPLE).collect()  # a fixed number of rows
    pivots = Pivots(_matrix([r.v for r in sample]), longest or 0.0)
    n_cells, n_pivots = max(1, min(len(pivots.points), n // BLOCK)), len(pivots.points)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = pivots.distances(pivots.stored(_matrix(batch["v"])))
            yield batch.assign(distances=list(d), cell=(np.argmin(d[:, :n_cells], axis=1) if n_pivots else 0))

    table = stash(rows.mapInPandas(measure, "id long, label long, v array<bigint>, anchor boolean, key long, distances array<double>, cell int"), "mining-pivots")
    drop_stash(rows)
    # a row a cell, PIVOTS at most
    least, most = (F.array(*[f(F.get("distances", F.lit(p))) for p in range(n_pivots)]) for f in (F.min, F.max))
    cells = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), least.alias("least"), most.alias("most")).orderBy("cell").collect()
    parts = {c.cell: -(-c.n // BLOCK) for c in cells}
    near, far = (np.array([c[k] for c in cells], float).reshape(len(cells), n_pivots) for k in ("least", "most"))
    n_parts = F.create_map(*[F.lit(x) for item in (parts or {0: 1}).items() for x in item])
    dealt = table.withColumn("part", F.pmod("key", n_parts[F.col("cell")]).cast("int"))

    def visits(limits) -> callable:
        """Anchors with the cells in which they can find something; limits gives each anchor's least and greatest score."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = _matrix(batch["v"])
                dq = pivots.of_queries(q)
                low, high = _bracket(dq, near, far, (q.astype(float) ** 2).sum(axis=1) + pivots.longest)
                least, most = limits(batch)
                ok = (high >= least[:, None]) & (low <= most[:, None])
                yield batch.assign(seen_from=list(dq), cells=[[cells[k].cell for k in np.flatnonzero(row)] for row in ok])

        return run

    base = "id long, label long, v array<bigint>, key long"
    blocks = lambda df: df.withColumn("to", F.explode("cells")).withColumn("to_part", F.explode(F.sequence(F.lit(0), n_parts[F.col("to")].cast("int") - 1)))
    found_as = "id long, key long, other long, other_key long, score long"

    def search(asked: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(dealt):
            block = _Block(asked, dealt, pivots.longest)
            ids, keys, others, other_keys = (x.tolist() for x in (asked["id"], asked["key"], dealt["id"], dealt["key"]))
            out = [(ids[i], keys[i], others[j], other_keys[j], max(-_LONG - 1, min(_LONG, s))) for i, j, s in _positives(block, asked["bar"].to_numpy(float), n_positives)]
        return pd.DataFrame(out, columns=["id", "key", "other", "other_key", "score"])

    def mine(asked: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(dealt):
            block = _Block(asked, dealt, pivots.longest)
            ids, keys, others, scores = (x.tolist() for x in (asked["id"], asked["key"], dealt["id"], asked["scores"]))
            for i, place, j, s in _negatives(block, scores, n_negatives, low_pct, high_pct):
                out.append((ids[i], keys[i], place, others[j], max(-_LONG - 1, min(_LONG, s))))
        return pd.DataFrame(out, columns=["id", "key", "place", "negative_id", "negative_score"])

    candidates = dealt.select("cell", "part", "id", "label", "v", "key", "distances")
    meet = lambda asked, work, shape: asked.groupBy("to", "to_part").cogroup(candidates.groupBy("cell", "part")).applyInPandas(work, shape)
    ranked = lambda df, k, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))).where(F.col("nth") <= k)

    chosen = dealt.where("anchor")
    at_home = chosen.select("id", "label", "v", "key", F.col("cell").alias("to"), F.col("part").alias("to_part"))
    everywhere = lambda batch: (np.full(len(batch), -np.inf), np.full(len(batch), np.inf))
    asked = at_home.mapInPandas(visits(everywhere), f"{base}, to int, to_part int, seen_from array<double>, cells array<int>").withColumn("bar", F.lit(float("-inf")))
    first = stash(ranked(meet(asked, search, found_as), n_positives, "id", "key"), "mining-home")
    bars = first.groupBy("id", "key").agg(F.when(F.count(F.lit(1)) == n_positives, F.min("score").cast("double")).otherwise(float("-inf")).alias("bar"))
    away = at_home.join(bars, ["id", "key"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))).select("id", "label", "v", "key", F.col("to").alias("home"), F.col("to_part").alias("home_part"), "bar")
    over_bar = lambda batch: (batch["bar"].to_numpy(float), np.full(len(batch), np.inf))
    asked = blocks(away.mapInPandas(visits(over_bar), f"{base}, home int, home_part int, bar double, seen_from array<double>, cells array<int>")).where("to != home or to_part != home_part")
    both = first.drop("nth").unionByName(meet(asked.drop("home", "home_part", "cells"), search, found_as))
    positives = stash(ranked(both, n_positives, "id", "key").select("id", "key", F.col("nth") - 1, "other", "score").toDF("id", "key", "place", "positive_id", "positive_score"), "mining-positives")
    drop_stash(first)

    # n_positives rows an anchor at most
    scores = positives.groupBy("id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))

    def band(batch: pd.DataFrame):
        held = [[int(s) for s in x if s >= 0] for x in batch["scores"]]
        return np.array([min(x, default=np.inf) * low_pct / 100 for x in held], float), np.array([max(x, default=-np.inf) * high_pct / 100 for x in held], float)

    asked = blocks(chosen.select("id", "label", "v", "key").join(scores, ["id", "key"]).mapInPandas(visits(band), f"{base}, scores array<bigint>, seen_from array<double>, cells array<int>")).drop("cells")
    found = meet(asked, mine, "id long, key long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return found.join(positives, ["id", "key", "place"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector: five positives, three negatives each, of 50 to 95 % of their score."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives(scaled, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
