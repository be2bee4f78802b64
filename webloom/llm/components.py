"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); a component is named by its smallest id.

    Each round, an id takes the least label among its own, its neighbours' and its label's label,
    until none changes; labels halve their way to the root, so rounds grow with the logarithm of
    the longest path. Only grouped minima are formed, never a component's list of members.
    """
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("low"))
        roots = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        moved = lower.join(roots, lower["low"] == roots["root"], "left").select("id", F.least("low", "above").alias("component"), (F.least("low", "above") != F.col("component")).alias("changed"))
        moved, old = stash(moved, "labels"), labels
        labels = moved.select("id", "component")
        changed = moved.where("changed").limit(1).count()
        drop_stash(old)
        if not changed:
            return labels
