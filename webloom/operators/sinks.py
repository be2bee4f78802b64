"""Writes of the crawl store as set operations: upserts, merges, deletions, and overwrites of partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import crawl, findings
from webloom.sources import tables as T


def update_else_insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the columns of rows set wherever the key is found, nulls too, and the other rows added.

    Keys of rows are distinct; a table's repeated keys are all updated. Columns that rows lack stay, null in what is added.
    """
    new = rows.select(F.col(key).alias("_key"), F.struct(*[c for c in rows.columns if c != key]).alias("_new"))
    both = table.join(new, table[key] == new["_key"], "full")
    given = [c for c in rows.columns if c != key]
    set_to = lambda c: F.when(F.col("_key").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.coalesce(F.col(key), F.col("_key")).alias(key) if c == key else set_to(c) if c in given else F.col(c) for c in table.columns])


def keep_richer(table: DataFrame, other: DataFrame, key: str, measure: str, also: list[str]) -> DataFrame:
    """table with the greater measure of both, and with other's columns ``also`` where its measure is greater; a null counts 0."""
    new = other.select(F.col(key).alias("_key"), F.struct(measure, *also).alias("_new"))
    old, found = F.coalesce(F.col(measure), F.lit(0)), F.col(f"_new.{measure}")
    richer = F.coalesce(found > old, F.lit(False))
    changed = {c: F.when(richer, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in also}
    grown = F.when((found > 0) & F.col("_key").isNotNull(), F.greatest(old, found)).otherwise(F.col(measure))
    return table.join(new, table[key] == new["_key"], "left").withColumns(changed | {measure: grown}).select(*table.columns)


def invalidate(issues: DataFrame, resolved: DataFrame) -> DataFrame:
    """issues without those of scope page_local whose url_id and issue_type are in resolved; others, and null keys, stay."""
    gone = resolved.select("url_id", "issue_type").distinct().withColumn("scope", F.lit("page_local"))
    return issues.join(gone, ["url_id", "issue_type", "scope"], "left_anti").select(*issues.columns)


def resolved_by_rendering(pages: DataFrame, thin: int = 200) -> DataFrame:
    """(url_id, issue_type) that rendered pages (url_id, h1, h2, word_count) settle."""
    settled = [F.lit("js_suspect_not_rendered"), F.when(F.col("h1") != "", "missing_h1"), F.when(F.col("h2") != "", "missing_h2"), F.when(F.col("word_count") >= thin, "thin_content")]
    return pages.select("url_id", F.explode(F.array_compact(F.array(*settled))).alias("issue_type"))


def persist(table: DataFrame, path: str, by: list[str]) -> None:
    """Append to a table kept in partitions."""
    table.write.mode("append").partitionBy(*by).parquet(path)


def replace_scope(table: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite those partitions alone that table has rows of; what fails leaves the old files."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def purge(table: DataFrame, at: str, before: Column) -> DataFrame:
    """table without rows from before a time; rows without a time stay."""
    return table.where(F.col(at).isNull() | (F.col(at) >= before))


def purge_cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, gone: Column) -> dict[str, DataFrame]:
    """The tables without the root's rows that are to go and all rows that hang on them.

    ``links`` has (child, its key, parent, the parent's key), a parent's own links before those to
    its children; a child may have several parents and goes with any of them. Only keys of rows that
    go are shuffled on. Rows without a key, and rows whose parent isn't there anyhow, stay; where
    ``gone`` is null, a row stays.
    """
    lost = F.coalesce(gone, F.lit(False))
    dead, left = {root: tables[root].where(lost)}, tables | {root: tables[root].where(~lost)}
    for child, key, parent, parent_key in links:
        keys = dead[parent].select(F.col(parent_key).alias("_key")).distinct()
        on = lambda df: df[key] == keys["_key"]  # noqa: B023, E731
        now = left[child].join(keys, on(left[child]), "left_semi")
        dead[child] = dead[child].unionByName(now) if child in dead else now
        left[child] = left[child].join(keys, on(left[child]), "left_anti")
    return left


def reap(jobs: DataFrame, reason: str, now: Column) -> DataFrame:
    """Jobs that still run or are being cancelled become failed ones."""
    orphan = F.coalesce(F.col("status").isin("running", "cancelling"), F.lit(False))
    set_to = {"status": F.lit("failed"), "finished_at": now, "error": F.lit(reason)}
    return jobs.withColumns({c: F.when(orphan, v).otherwise(F.col(c)) for c, v in set_to.items()})


def snk_update_else_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets but for every fifth, updated by every second, with sizes doubled."""
    a = T.assets(spark, sf_dir)
    rows = a.where("asset_id % 2 = 0").select("asset_id", (F.col("content_length") * 2).alias("content_length"))
    return update_else_insert(a.where("asset_id % 5 != 0"), rows, "asset_id")


def snk_update_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after rendering, which found some words more or fewer."""
    p = T.pages(spark, sf_dir).select("url_id", "word_count", "h1", "depth")
    rendered = p.where("url_id % 4 != 3").select("url_id", (F.col("word_count") + F.col("url_id") % 5 - 2).alias("word_count"), F.concat(F.lit("rendered "), "h1").alias("h1"))
    return keep_richer(p, rendered, "url_id", "word_count", ["h1"])


def snk_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin pages and pages without heading, less what every second page's rendering settled."""
    p = T.pages(spark, sf_dir).select("url_id", "h1", "h2", "word_count")
    of = lambda kind, c, scope: p.where(c).select("url_id", F.lit(kind).alias("issue_type"), F.lit(scope).alias("scope"))
    found = of("thin_content", "word_count < 200", "page_local").unionByName(of("missing_h1", "h1 = ''", "page_local")).unionByName(of("thin_content", "word_count < 50", "global"))
    return invalidate(found, resolved_by_rendering(p.where("url_id % 2 = 0").withColumns({"word_count": F.col("word_count") + 100, "h1": F.lit("x")})))


def snk_replace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on fetches kept by severity, of which the errors are then written anew for even fetches alone."""
    crawl.ready_to_checkpoint(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/issues-{uuid.uuid4().hex}"
    found = findings.fetch_rules(spark, sf_dir)
    persist(found, path, ["severity"])
    replace_scope(found.where("severity = 'error' and fetch_seq % 2 = 0"), path, ["severity"])
    return spark.read.schema(found.schema).parquet(path).select("fetch_seq", "issue_type", "severity")


def snk_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge(T.fetches(spark, sf_dir), "fetched_at", F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("fetch_seq", "url_id")


def snk_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs taken as jobs: those pending run."""
    jobs = T.urls(spark, sf_dir).select("url_id", F.when(F.col("status") == "pending", "running").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return reap(jobs, "orphaned", F.lit("2024-01-31"))


QUERIES = {f.__name__: f for f in (snk_update_else_insert, snk_update_case, snk_invalidate, snk_replace_scope, snk_purge, snk_reap)}
