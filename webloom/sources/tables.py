"""Crawl tables as DataFrames, derived from the pages, events and lineitem tables.

Keys are natural: url_id is the page id, fetch_seq the event id. Every view is a narrow projection,
so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import host, sitemap_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_id, url, host, status, discovered_via."""
    p = table(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 10 == 7, "robots_blocked").when(F.col("page_id") % 10 == 8, "pending").otherwise("fetched")
    via = F.when(F.col("page_id") % 4 == 0, "seed").when(F.col("page_id") % 4 == 1, "sitemap").otherwise("link")
    return p.select(F.col("page_id").alias("url_id"), "url", host("url").alias("host"), status.alias("status"), via.alias("discovered_via"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_id, url, fetch_seq, title, h1, description, h2, content_hash, word_count, depth, canonical_id, indexability_state."""
    p = table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    state = F.when(F.col("page_id") % 7 == 3, "noindex_meta").when(F.col("page_id") % 7 == 5, "noindex_header").otherwise("indexable")
    title, h1 = (F.trim(F.regexp_extract("html", f"<{tag}>([^<]*)</", 1)) for tag in ("title", "h1[^>]*"))
    return p.select(
        F.col("page_id").alias("url_id"),
        "url",
        (F.col("page_id") * 37 % 1009 * 100000 + F.col("page_id")).alias("fetch_seq"),
        title.alias("title"),
        h1.alias("h1"),
        F.when(title != "", F.concat(F.lit("About "), F.substring(title, 1, 8))).otherwise("").alias("description"),
        F.substring(h1, 1, 6).alias("h2"),
        F.sha2(text, 256).alias("content_hash"),
        F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long").alias("word_count"),
        (F.col("page_id") % 6).alias("depth"),
        (F.col("page_id") - F.col("page_id") % 3).alias("canonical_id"),
        state.alias("indexability_state"),
    )


def _with_n(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """df with n, the number of page ids: one row joined on, so building a plan runs no job."""
    return df.crossJoin(F.broadcast(table(spark, sf_dir, "pages").agg((F.max("page_id") + 1).alias("n"))))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_seq, url_id, status_code, ttfb_ms, fetched_at, final_id, hop_count, loop, exceeded."""
    e, n = _with_n(table(spark, sf_dir, "events"), spark, sf_dir), F.col("n")
    status = F.when(F.col("event_type") == "purchase", 404).when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 301).otherwise(200)
    url_id, moved = F.col("user_id") % n, status == 301
    return e.select(
        F.col("event_id").alias("fetch_seq"),
        url_id.alias("url_id"),
        status.alias("status_code"),
        F.floor(F.col("value") * 10).alias("ttfb_ms"),
        F.col("ts").alias("fetched_at"),
        F.when(moved, (url_id * 3 + 1) % n).otherwise(url_id).alias("final_id"),
        F.when(moved, F.col("event_id") % 4).otherwise(0).alias("hop_count"),
        (moved & (F.col("event_id") % 50 == 0)).alias("loop"),
        (moved & (F.col("event_id") % 60 == 0)).alias("exceeded"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, relation_type, is_internal, discovery_mode."""
    line, n = _with_n(table(spark, sf_dir, "lineitem"), spark, sf_dir), F.col("n")
    relation = F.when(F.col("l_returnflag") == "R", "canonical").when(F.col("l_returnflag") == "A", "hreflang").otherwise("link")
    return line.select(
        (F.col("l_partkey") % n).alias("source_id"),
        (F.col("l_suppkey") * 7 % n).alias("target_id"),
        relation.alias("relation_type"),
        (F.col("l_linestatus") == "F").alias("is_internal"),
        F.when(F.col("l_linenumber") % 2 == 0, "browser").otherwise("static").alias("discovery_mode"),
    )


def hreflangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, lang: every third page names the next one, half of those name it back."""
    p = table(spark, sf_dir, "pages").select("page_id")
    target = F.when(F.col("page_id") % 3 == 0, F.col("page_id") + 1).when(F.col("page_id") % 6 == 1, F.col("page_id") - 1)
    return p.select(F.col("page_id").alias("source_id"), target.alias("target_id"), F.when(F.col("page_id") % 3 == 0, "de").otherwise("en").alias("lang")).where("target_id is not null")


def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_id, next_id, prev_id: runs of five pages."""
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select(i.alias("url_id"), F.when(i % 5 < 4, i + 1).alias("next_id"), F.when(i % 5 > 0, i - 1).alias("prev_id"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, url_id, kind, content_length."""
    a = _with_n(table(spark, sf_dir, "part"), spark, sf_dir)
    kind = F.when(F.col("p_size") % 3 == 0, "css").otherwise("img_src")
    return a.select(F.col("p_partkey").alias("asset_id"), (F.col("p_partkey") % F.col("n")).alias("url_id"), kind.alias("kind"), (F.col("p_size").cast("long") * 5000 + F.col("p_partkey") % 1000).alias("content_length"))


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, source, key: two thirds of the pages under varied spellings, every fifth in a second sitemap too."""
    p = table(spark, sf_dir, "pages").where("page_id % 3 != 0")
    one = p.select(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"), (F.col("page_id") % 4).alias("source"))
    two = p.where("page_id % 5 = 0").select(F.regexp_replace("url", "^https?://", "http://www.").alias("url"), (F.col("page_id") % 4 + 1).alias("source"))
    return one.union(two).withColumn("key", sitemap_key("url"))
