"""Exact top-k search by inner product, with bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates, and of queries; segments of a vector, coarse to fine.
BLOCK, QUERY_BLOCK, SEGMENTS = 4096, 4096, (4, 16)
_SLICE = 128


def _matrix(column) -> np.ndarray:
    width = max((len(v) for v in column), default=0)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _profile(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a vector's segments, scaled so that the product of two profiles is at least the product of the vectors."""
    length = -(-x.shape[1] // segments) if x.shape[1] else 1
    padded = np.zeros((len(x), segments * length))
    padded[:, : x.shape[1]] = x
    parts = padded.reshape(len(x), segments, length)
    mean = parts.mean(axis=2)
    spread = np.sqrt(np.maximum((parts**2).mean(axis=2) - mean**2, 0))
    return np.concatenate((mean, spread), axis=1) * np.sqrt(length)


def block_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate, score) of each query's k best candidates of a block.

    The inner product of two vectors is the sum over segments of length * (product of means + mean
    product of offsets), and by Cauchy and Schwarz the latter is at most the product of deviations.
    So |q|^2 + |c|^2 less twice the bound is a lower bound of the squared distance. The k-th best
    exact score among the candidates with the best coarse bounds is the bar; only candidates whose
    coarse bound, then fine bound, reach it are scored exactly. Scores beyond the range of a long
    are its ends; ties go to the smaller id. Empty blocks give nothing.
    """
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    big = width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) >= 2**53
    profiles = [(_profile(q, s), _profile(c, s)) for s in SEGMENTS]
    out: list[tuple] = []
    for at in range(0, len(q), _SLICE):
        rows = slice(at, min(at + _SLICE, len(q)))
        own = qid[rows, None] == cid[None, :]
        bound = profiles[0][0][rows] @ profiles[0][1].T
        slack = 1 + 1e-9 * np.abs(bound).max(initial=0)
        bound[own] = -np.inf
        n_seed = min(4 * k, len(c))
        seed = np.argpartition(-bound, n_seed - 1, axis=1)[:, :n_seed]
        exact = np.einsum("ij,ikj->ik", q[rows], c[seed])
        exact[np.take_along_axis(own, seed, 1)] = -np.inf
        bar = -np.partition(-exact, min(k, n_seed) - 1, axis=1)[:, min(k, n_seed) - 1] if n_seed >= k else np.full(len(exact), -np.inf)
        i, j = np.nonzero((bound >= bar[:, None] - slack) & ~own)
        for fine_q, fine_c in profiles[1:]:
            ok = np.einsum("ij,ij->i", fine_q[at + i], fine_c[j]) >= bar[i] - slack
            i, j = i[ok], j[ok]
        if big:  # beyond exact doubles: Python's integers, held to the range of a long
            score = np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[at + x], c[y], strict=True)))) for x, y in zip(i, j, strict=True)], dtype=np.int64)
        else:
            score = np.einsum("ij,ij->i", q[at + i], c[j]).astype(np.int64)
        order = np.lexsort((cid[j], ~score, i))  # the complement of an integer falls as it rises, without overflow
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        out.append((at + i[best], cid[j[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), cid[:0], np.zeros(0, np.int64))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Each query's k candidates of highest inner product (all, if fewer), ties to the smaller id.

    Vectors are arrays of integers. Candidates and queries are dealt into blocks by hash; each pair
    of blocks is one task's work, which returns k rows a query, and these are ranked. The number of
    blocks follows the number of rows. Vectors that are null or have null elements, and rows with a
    null id, take no part; shorter vectors count as if filled with zeros. Rows equal in id and
    vector count once; rows that share only the id are rows of their own, each with its own ranks. No
    row of a query's id is a candidate for it. Empty tables give an empty result; extra columns are ignored.

    Returns query_id, rank (from 1), vec_id, score.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)")

    candidates, queries = usable(vectors), usable(queries)
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((candidates, BLOCK), (queries, QUERY_BLOCK)))
    candidates, queries = (df.withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key"]) for df in (candidates, queries))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = candidates.select(part(blocks).alias("c_block"), numbers(query_blocks).alias("q_block"), "id", "v")
    asked = queries.select(numbers(blocks).alias("c_block"), part(query_blocks).alias("q_block"), "id", "v", "key")

    def work(asked: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(dealt):
            return pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": []}, dtype="int64")
        at, found, score = block_topk(asked["id"].to_numpy(), _matrix(asked["v"]), dealt["id"].to_numpy(), _matrix(dealt["v"]), k)
        return pd.DataFrame({"query_id": asked["id"].to_numpy()[at], "key": asked["key"].to_numpy()[at], "vec_id": found, "score": score})

    key = ("c_block", "q_block")
    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(work, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest by integer inner product for every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    scaled = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    return topk(scaled, scaled.where(F.col("vec_id") % 100 == 0), 10)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
