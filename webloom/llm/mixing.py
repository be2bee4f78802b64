"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

SEED = "mix-1"
#: Power with which inclusion odds fall with a document's size.
SIZE_POWER = 0.25
#: Slices of the order in each source; one task sorts the rows of a slice.
SLICES = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: source_size, n_docs and target.

    ``share`` of all sizes is dealt by weight (weights repeat over the sources by code point, null
    last); a target stops at ``most`` times its source's size, and the excess is dealt again by
    weight until no target is above. That fixed point is min(cap, level * weight) with one level,
    found by ordering the sources by cap / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "words": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    first, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(first), F.lit(0.0)) + F.col("cap") / F.col("weight") * F.sum("weight").over(rest)
    ranked = ranked.withColumn("capped", filled <= F.col("words"))
    everything = Window.partitionBy()
    level = (F.col("words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return ranked.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def pareto_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Every document of a source gets the whole copies that are certain, floor(target / source_size).
    The words still missing are drawn by Pareto order sampling: a document of size s has inclusion
    probability p = c * (mean size / s) ** SIZE_POWER, with c such that the expected words are those
    missing; documents that would reach 1 are certain and taken, and c is that of the rest. The rest
    are ranked by [u / (1 - u)] / [p / (1 - p)] with u a fixed function of id and seed, and taken
    in that order up to the size that is fixed in advance, the number of words then missing. The
    document on which the count ends is taken if that comes nearer to it.

    c needs the counts of sizes in each source only. A source's order is cut into SLICES of about
    equally many documents; slice totals give each slice's offset, so a hot source is never in one
    task. Documents that are certain, or of a source without missing words, are in no order at all.
    Documents of size 0 stay whole copies only and count for nothing.

    A null text or one without words has size 0; a null source is a source of its own. Rows with
    equal ids share u and are told apart by size. An empty table gives an empty result; columns
    other than id, text and source are ignored.

    Returns doc_id, source, size, source_size, target, copies, taken.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return _mix(stash(sizes, "mix-sizes"), weights, share, most, seed)


def _weight() -> Column:
    return F.pow(F.col("mean") / F.greatest(F.col("size"), F.lit(1)), F.lit(SIZE_POWER))


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with missing words: level (the c of its probabilities), certain_upto (sizes that are surely taken) and left (words that the order must give).

    Small documents have the larger probabilities, so those that are certain are the sizes up to a
    limit. With every size taken as the first that is not certain, the least of them for which
    its own probability is no more than 1 is the right one.
    """
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(targets.where("missing > 0"), counts["source"].eqNullSafe(targets["source"])).select(counts["source"], "size", "n", "missing", _weight().alias("w"))
    order = Window.partitionBy("source").orderBy("size")
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("w") * F.col("size") * F.col("n")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("left", F.col("missing") - before).withColumn("level", F.col("left") / after)
    fit = rows.where("level * w <= 1").groupBy("source").agg(F.min_by(F.struct("size", "level", "left"), "size").alias("x"))
    return fit.select(F.col("source").alias("of"), (F.col("x.size") - 1).alias("certain_upto"), "x.level", "x.left")


def _mix(sizes: DataFrame, weights, share, most, seed) -> DataFrame:
    targets = source_targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumns({"whole": F.floor(rate), "mean": F.col("source_size") / F.col("n_docs")})
    targets = targets.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stash(targets, "mix-targets")
    levels = inclusion(sizes, targets)
    targets = stash(targets.join(levels, targets["source"].eqNullSafe(levels["of"]), "left").drop("of"), "mix-levels")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    p = F.least(F.col("level") * _weight(), F.lit(1.0))
    odds = F.when(p < 1, p / (1 - p)).otherwise(F.lit(float("inf")))
    same = sizes["source"].eqNullSafe(targets["source"])
    ranked = sizes.join(targets, same).select("doc_id", sizes["source"], "size", "source_size", "target", "whole", "left", "level", "certain_upto", (u / (1 - u) / odds).alias("rank"))
    copies = lambda drawn: (F.col("whole") + drawn.cast("long")).cast("int")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    # the rank times the odds of the level is about u / (1 - u), whose share of one is spread evenly over the slices
    typical = F.least(F.greatest("level", F.lit(1e-12)), F.lit(1 - 1e-12))
    even = F.col("rank") * (typical / (1 - typical))
    ranked = stash(ranked.withColumn("slice", F.least(F.floor(even / (1 + even) * SLICES), F.lit(SLICES - 1))), "mix-ranked")
    certain = F.col("size") <= F.col("certain_upto")
    ordered = (F.col("size") > 0) & F.col("level").isNotNull() & ~certain
    rest = ranked.where(~F.coalesce(ordered, F.lit(False))).select(*columns, copies(F.coalesce(certain & (F.col("size") > 0), F.lit(False))).alias("copies"))
    drawable = ranked.where(ordered)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawable.groupBy("source", "slice").agg(F.sum("size").alias("words")).select(F.col("source").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = drawable.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    drawn = run.select(*columns, copies(F.col("offset") + F.col("ahead") + F.col("size") / 2.0 <= F.col("left")).alias("copies"))
    return rest.union(drawn).withColumn("taken", F.col("copies") * F.col("size"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 3, 1, 2 over the sources, 150 % of all words, at most 2 copies."""
    mixed = pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, CAST(source_size AS DOUBLE) * 2.0 AS cap,
        CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
        CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS words FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
        + cap / weight * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= words AS capped FROM w),
t AS (SELECT source, source_size, n_docs, CASE WHEN capped THEN cap ELSE
        (words - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () * weight END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
g AS (SELECT *, floor(rate) AS whole, target - floor(rate) * source_size AS missing, source_size / n_docs AS mean FROM r),
z AS (SELECT d.source, d.size, count(*) AS n, any_value(missing) AS missing, pow(any_value(mean) / d.size, {SIZE_POWER}) AS w
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE d.size > 0 AND missing > 0 GROUP BY d.source, d.size),
y AS (SELECT *, missing - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
        sum(w * size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM z),
k AS (SELECT source, min(size) AS first_size, arg_min(left_ / rest, size) AS level, arg_min(left_, size) AS left_ FROM y WHERE left_ / rest * w <= 1 GROUP BY source),
u AS (SELECT d.doc_id, d.size, g.*, k.first_size, k.left_, (CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':{SEED}'), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u,
        least(1.0, k.level * pow(mean / greatest(d.size, 1), {SIZE_POWER})) AS p
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
o AS (SELECT *, CASE WHEN size > 0 AND first_size IS NOT NULL AND size >= first_size THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN size = 0 OR first_size IS NULL THEN 0 WHEN rank IS NULL OR ahead + size / 2.0 <= left_ THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""
