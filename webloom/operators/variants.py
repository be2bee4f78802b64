"""Spellings of one page as clusters with classes, and groups of URLs by configured and by frequent patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.sources import tables as T

# Fixed value: pages from which a first path segment makes a group of its own.
LEAST_GROUP = 10


def page_key(url: Column) -> Column:
    """The identity key of a URL; one that has none is its own key, without blanks around it and slashes at its end."""
    return F.coalesce(U.identity(url), F.regexp_replace(F.trim(url), "/+$", ""))


def _given(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def url_spellings(pages: DataFrame) -> DataFrame:
    """Every spelling under which a page was asked for, reached or declared: page_key, kind, url, page_id, status_code, indexability_state.

    pages: page_id, page_url, requested_url, final_url, canonical_url, content_hash, indexability_state, status_code. A page
    belongs to the key of its canonical URL, else of its own. A spelling that several pages of a cluster have is one row, of
    the least page_id.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("url")) for k, c in (("requested", _given("requested_url")), ("final", F.coalesce(_given("final_url"), _given("page_url"))), ("canonical", _given("canonical_url")))])
    keyed = pages.withColumn("page_key", page_key(F.coalesce(_given("canonical_url"), F.col("page_url")))).where("page_key != ''")
    each = keyed.select("page_key", "page_id", "status_code", "indexability_state", F.explode(kinds).alias("v")).where("v.url is not null").select("page_key", "v.kind", "v.url", "page_id", "status_code", "indexability_state")
    first = F.min_by(F.struct("page_id", F.coalesce("status_code", F.lit(0)).alias("status_code"), "indexability_state"), "page_id").alias("x")
    return each.groupBy("page_key", "kind", "url").agg(first).select("page_key", "kind", "url", "x.*")


def url_clusters(pages: DataFrame) -> DataFrame:
    """One row a page key: page_key, primary_url, canonical_url, content_hash, variant_count, page_count, cluster_type, issue_severity.

    Classes: 'redirect_consolidated' has one page URL; 'distinct_content' has pages that differ; 'canonicalized_duplicate' (info)
    has one canonical key, the cluster's own; all else is 'duplicate_content_variant' (warning). The primary URL and the
    content are those of the first page, the canonical URL is the last page's. Only counts, extremes and
    distinct pairs are kept of a cluster, so one with very many pages is folded before it is moved.
    """
    keyed = pages.withColumn("page_key", page_key(F.coalesce(_given("canonical_url"), F.col("page_url")))).where("page_key != ''")
    content, canonical = _given("content_hash"), _given("canonical_url")
    own = F.when(canonical.isNotNull(), page_key(canonical))
    facts = keyed.groupBy("page_key").agg(
        F.min_by("page_url", "page_id").alias("primary_url"),
        F.max_by("canonical_url", F.when(canonical.isNotNull(), F.col("page_id"))).alias("canonical_url"),
        F.min_by("content_hash", F.when(content.isNotNull(), F.col("page_id"))).alias("content_hash"),
        (F.min("page_url") != F.max("page_url")).alias("several"),
        F.coalesce(F.min(content) != F.max(content), F.lit(False)).alias("differ"),
        F.coalesce((F.min(own) == F.max(own)) & (F.min(own) == F.first("page_key")), F.lit(False)).alias("agreed"),
    )
    counts = url_spellings(pages).groupBy("page_key").agg(F.count(F.lit(1)).alias("variant_count"))
    page_counts = keyed.select("page_key", "page_url").distinct().groupBy("page_key").agg(F.count(F.lit(1)).alias("page_count"))
    kind = F.when(~F.col("several"), "redirect_consolidated").when(F.col("differ"), "distinct_content").when(F.col("agreed"), "canonicalized_duplicate").otherwise("duplicate_content_variant")
    severity = F.when(kind == "canonicalized_duplicate", "info").when(kind == "duplicate_content_variant", "warning")
    joined = facts.join(page_counts, "page_key").join(counts, "page_key", "left")
    return joined.select("page_key", "primary_url", "canonical_url", "content_hash", F.coalesce("variant_count", F.lit(0)).alias("variant_count"), "page_count", kind.alias("cluster_type"), severity.alias("issue_severity"))


def ordered_clusters(clusters: DataFrame, most: int) -> DataFrame:
    """The first clusters of a report, which is the limit's use: those with an issue, then the largest, then by URL."""
    return clusters.orderBy(F.col("issue_severity").isNotNull().desc(), F.desc("variant_count"), "primary_url").limit(most)


def _under(path: Column, pattern: str) -> Column:
    """Whether a path fits a pattern as a glob, or lies at or below it."""
    return U.glob_match(path, pattern) | (path == pattern) | path.startswith(pattern + "/")


def _covers(own: Column, pattern: str) -> Column:
    """Whether a configured pattern speaks for an automatic one, so that the latter makes no group."""
    globs = [pattern.index(c) for c in "*?[" if c in pattern]
    if globs:
        base = pattern[: min(globs)].rstrip("/") or "/"
        return U.glob_match(own, pattern) | (own == base) | own.startswith(base + "/" if base != "/" else "//")
    return _under(own, pattern)


def grouped_urls(urls: DataFrame, user_groups: list[tuple[str, str]], least: int = LEAST_GROUP) -> DataFrame:
    """urls (url_id, url) with url_group and group_source ('user', 'auto' or null).

    ``user_groups`` are names and patterns in order; a pattern is a glob of the whole path or a path below which a URL lies. Of
    several that fit the last holds. Where none fits, the first path segment is the group if ``least`` pages have it
    and no configured pattern covers it. The counts are one row a segment; no page is collected by group.
    """
    path = U.decoded_path("url")
    user = F.coalesce(*[F.when(_under(path, pattern), F.lit(name)) for name, pattern in reversed(user_groups)], F.lit(None).cast("string"))
    segment = F.get(F.split(F.regexp_replace(path, "/+$", ""), "/"), F.lit(1))
    keyed = urls.select("url_id", "url", user.alias("_user"), F.when(F.coalesce(segment, F.lit("")) != "", segment).alias("_segment"))
    covered = F.lit(False)
    for _, pattern in user_groups:
        covered = covered | _covers(F.concat(F.lit("/"), F.col("_segment")), pattern)
    auto = keyed.where("_segment is not null").groupBy("_segment").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).where(~covered).select("_segment", F.col("_segment").alias("_auto"))
    joined = keyed.join(auto, "_segment", "left")
    source = F.when(F.col("_user").isNotNull(), "user").when(F.col("_auto").isNotNull(), "auto")
    return joined.select("url_id", "url", F.coalesce("_user", "_auto").alias("url_group"), source.alias("group_source"))


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their latest fetch's end and a canonical URL: none, that of a neighbour, or their own with a slash more."""
    p = T.pages(spark, sf_dir).select("url_id", "url", "content_hash", "indexability_state")
    last = T.fetches(spark, sf_dir).groupBy("url_id").agg(F.max_by("final_id", "fetch_seq").alias("final_id"), F.max_by("status_code", "fetch_seq").alias("status_code"))
    other = lambda key, name: p.select(F.col("url_id").alias(key), F.col("url").alias(name))
    near = p.withColumn("near_id", F.col("url_id") - F.col("url_id") % 6).join(last, "url_id", "left").join(other("final_id", "final_url"), "final_id", "left").join(other("near_id", "near_url"), "near_id", "left")
    canonical = F.when(F.col("url_id") % 3 == 1, F.col("near_url")).when(F.col("url_id") % 3 == 2, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")))
    content = F.when(F.col("url_id") % 12 < 6, F.lit("same")).otherwise(F.col("content_hash"))
    return near.select(F.col("url_id").alias("page_id"), F.col("url").alias("page_url"), F.col("url").alias("requested_url"), "final_url", canonical.alias("canonical_url"), content.alias("content_hash"), "indexability_state", "status_code")


def url_variant_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of spellings, classified."""
    return url_clusters(_spelled(spark, sf_dir)).drop("content_hash")


def url_variant_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings of every cluster."""
    return url_spellings(_spelled(spark, sf_dir)).select("page_key", "kind", "url", "page_id", "status_code")


def report_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty clusters in the report's order: the limit is the feature."""
    return ordered_clusters(url_clusters(_spelled(spark, sf_dir)), 50).select("page_key", "variant_count", "cluster_type")


def url_group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL with its group, three of them configured."""
    return grouped_urls(T.urls(spark, sf_dir), [("german", "/de"), ("ones", "/e?/1*"), ("files", "/*/*.html")]).select("url_id", "url_group", "group_source")


QUERIES = {f.__name__: f for f in (url_variant_clusters, url_variant_spellings, report_clusters, url_group_pages)}
