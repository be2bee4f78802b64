"""Streams over the fetch log: traps, slow hosts, rate limits, the frontier's first sightings, counts, and the feed.

A stream reads files as they come; ``drain`` runs one over all that is there and returns what it wrote.
State is one row a key and bounded; a key's rows of one micro-batch are put in order by their number,
so a trigger's files bound what a task holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators import crawl

# Queries that a path may have, samples of a host's mean and its limit, hits a window.
MOST_QUERIES, RING, SLOW_HOST_MS, HITS, WINDOW_MS = 50, 10, 5000, 10, 3_600_000


def stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream, ``files`` files a trigger."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path has to be a folder, a pattern may match a file
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has, into a table of the shared folder; in mode 'complete' the last batch's table holds."""
    spark = df.sparkSession
    crawl.ready_to_checkpoint(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    out = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/state")
    if mode == "append":
        query = out.format("parquet").option("path", f"{place}/rows").start()
    else:
        query = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/rows")


def _stateful(df: DataFrame, key: str, output: str, state: str, run: Callable) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def _in_order(parts: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """The named columns of a key's rows of one micro-batch, by the first of them."""
    rows = [[p[n].to_numpy() for n in names] for p in parts]
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def traps(rows: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """From path and query: a row (path, n_queries) once a path has over ``most`` different queries; empty ones don't count.

    After that a path's queries are forgotten, so that no state exceeds ``most`` + 1 strings.
    """

    def run(key, parts, state: GroupState):
        seen, flagged = state.get if state.exists else ([], False)
        known = set(seen)
        for part in parts:
            for q in part["query"] if not flagged else ():
                if q and q not in known:
                    known.add(q)
                    if len(known) > most:
                        flagged = True
                        yield pd.DataFrame({"path": [key[0]], "n_queries": [len(known)]})
                        break
        state.update(([] if flagged else sorted(known), flagged))

    return _stateful(rows, "path", "path string, n_queries long", "seen array<string>, flagged boolean", run)


def slow_hosts(rows: DataFrame, limit: int = SLOW_HOST_MS, size: int = RING) -> DataFrame:
    """From host, seq and ttfb_ms: a row (host, seq, avg_ms) the first time that a host's last ``size`` samples have a mean, in whole ms, over the limit."""

    def run(key, parts, state: GroupState):
        ring, flagged = state.get if state.exists else ([], False)
        seq, ms = _in_order(parts, "seq", "ttfb_ms")
        if not flagged:
            values = np.concatenate((np.array(ring, np.int64), ms))
            upto = np.concatenate(([0], np.cumsum(values)))
            means = (upto[size:] - upto[:-size]) // size
            over = np.flatnonzero(means > limit)
            if len(over):
                flagged = True
                at = int(over[0]) + size - 1 - len(ring)
                yield pd.DataFrame({"host": [key[0]], "seq": [int(seq[at])], "avg_ms": [int(means[over[0]])]})
            ring = values[-(size - 1) :].tolist() if size > 1 else []
        state.update(([] if flagged else ring, flagged))

    return _stateful(rows, "host", "host string, seq long, avg_ms long", "ring array<long>, flagged boolean", run)


def rate_limited(rows: DataFrame, hits: int = HITS, window_ms: int = WINDOW_MS) -> DataFrame:
    """From key, seq and at_ms: every row (key, seq, allowed); a window begins with the first hit after the last one's end, and allows ``hits``."""

    def run(key, parts, state: GroupState):
        count, start = state.get if state.exists else (0, None)
        seq, at = _in_order(parts, "seq", "at_ms")
        allowed = np.zeros(len(seq), bool)
        for i, t in enumerate(at.tolist()):
            if start is None or t - start >= window_ms:
                count, start = 0, t
            allowed[i] = count < hits
            count += bool(allowed[i])
        state.update((count, start))
        yield pd.DataFrame({"key": key[0], "seq": seq, "allowed": allowed})

    return _stateful(rows, "key", "key string, seq long, allowed boolean", "count int, start long", run)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, f"{sf_dir}/events.parquet")


def st_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "event_type", (F.col("user_id") % 5).cast("string"))
    return drain(traps(_events(spark, sf_dir).select(path.alias("path"), F.col("props").alias("query")), 30))


def st_slow_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("value") * 10)
    return drain(slow_hosts(_events(spark, sf_dir).select((F.col("user_id") % 40).cast("string").alias("host"), F.col("event_id").alias("seq"), ms.alias("ttfb_ms")), 500))


def st_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of ten kinds of users, three a window of a day by event number."""
    return drain(rate_limited(_events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("at_ms")), 3, 100))


def st_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sightings of pairs of user and kind."""
    return drain(_events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def st_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(_events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


def st_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a watermark, as a resumed feed sends them."""
    return drain(_events(spark, sf_dir).where("event_id > 500").select("event_id", "event_type"))


QUERIES = {f.__name__: f for f in (st_trap, st_slow_host, st_rate_limit, st_frontier, st_count_cache, st_feed)}
