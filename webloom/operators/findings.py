"""Further cross-page detectors, rules on fetches, and one table of issues with severity, scope and details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.scope import in_scope
from webloom.operators import crawl
from webloom.sources import tables as T

# Limits of the rules.
DEEP_PAGE, IMAGE_BYTES, SITEMAP_ROWS = 3, 102_400, 50_000
SLOW_MS, VERY_SLOW_MS = 3000, 10_000
REDIRECTS = (301, 302, 307, 308)


def _status_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Latest status of every fetched URL, its id under the given name."""
    return crawl.win_latest(spark, sf_dir).select(F.col("url_id").alias(name), "status_code")


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over DEEP_PAGE links from the nearest seed, by recomputed depths."""
    return crawl.page_depths(spark, sf_dir).where(F.col("depth") > DEEP_PAGE).select("url_id", "depth", F.lit(DEEP_PAGE).alias("threshold"))


def hreflang_not_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages of which only one names the other as its translation."""
    pairs = T.hreflangs(spark, sf_dir).where("source_id != target_id").select("source_id", "target_id").distinct()
    back = pairs.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return pairs.join(back, ["source_id", "target_id"], "left_anti").withColumnRenamed("source_id", "url_id")


def broken_hreflang_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations whose latest fetch is not 200; those never fetched are left out."""
    pairs = T.hreflangs(spark, sf_dir).select(F.col("source_id").alias("url_id"), "target_id").distinct()
    return pairs.join(_status_of(spark, sf_dir, "target_id"), "target_id").where("status_code != 200").select("url_id", "target_id", "status_code")


def canonical_to_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir).where("canonical_id != url_id").select("url_id", "canonical_id")
    return p.join(_status_of(spark, sf_dir, "canonical_id"), "canonical_id").where(F.col("status_code").isin(*REDIRECTS)).select("url_id", "canonical_id", "status_code")


def broken_pagination_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next and previous pages whose latest fetch is not 200: a row for each of the two."""
    both = F.explode(F.array(F.struct(F.lit("next").alias("rel"), F.col("next_id").alias("target_id")), F.struct(F.lit("prev").alias("rel"), F.col("prev_id").alias("target_id"))))
    links = T.paginated(spark, sf_dir).select("url_id", both.alias("x")).select("url_id", "x.rel", "x.target_id").where("target_id is not null")
    return links.join(_status_of(spark, sf_dir, "target_id"), "target_id").where("status_code != 200").select("url_id", "rel", "target_id", "status_code")


def pagination_canonical_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a sequence whose canonical is another page."""
    linked = T.paginated(spark, sf_dir).where("next_id is not null or prev_id is not null").select("url_id")
    return T.pages(spark, sf_dir).where("canonical_id != url_id").select("url_id", "canonical_id").join(linked, "url_id", "left_semi")


def sitemap_non_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap rows that equal a URL but for slashes at the end, whose latest fetch is not 200."""
    bare = F.regexp_replace("url", "/+$", "")
    listed = T.sitemap(spark, sf_dir).select(bare.alias("bare"), F.col("url").alias("sitemap_url"))
    known = T.urls(spark, sf_dir).select("url_id", bare.alias("bare"))
    return listed.join(known, "bare").join(_status_of(spark, sf_dir, "url_id"), "url_id").where("status_code != 200").select("url_id", "sitemap_url", "status_code")


def sitemap_url_redirect_host_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the sitemap whose latest fetch ended on another host."""
    last = T.fetches(spark, sf_dir).groupBy("url_id").agg(F.max_by("final_id", "fetch_seq").alias("final_id"))
    u = T.urls(spark, sf_dir).select("url_id", "url", "host")
    listed = u.select("url_id", F.col("host").alias("requested_host"), F.regexp_replace("url", "/+$", "").alias("bare")).join(T.sitemap(spark, sf_dir).select(F.regexp_replace("url", "/+$", "").alias("bare")), "bare", "left_semi")
    final = u.select(F.col("url_id").alias("final_id"), F.col("host").alias("final_host"))
    return listed.join(last, "url_id").join(final, "final_id").where("requested_host != final_host").select("url_id", "requested_host", "final_host")


def sitemap_url_external_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sitemap key on a host out of scope, the scope being the domain example.org."""
    outside = T.sitemap(spark, sf_dir).withColumn("host", U.host("url")).where("host != ''").where(~in_scope("url", "registrable_domain", "www.example.org"))
    return outside.groupBy("key").agg(F.min("url").alias("url"), F.min("host").alias("host"))


def image_over_100kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of over IMAGE_BYTES: one a page, the largest, in whole kilobytes."""
    large = T.assets(spark, sf_dir).where((F.col("kind") == "img_src") & (F.col("content_length") > IMAGE_BYTES))
    return large.groupBy("url_id").agg(F.floor(F.max("content_length") / 1024).alias("size_kb"))


def sitemap_too_large(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """Sitemaps with over ``most`` rows; the rule's own limit is SITEMAP_ROWS, which none of the test tables reaches."""
    return T.sitemap(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("entry_count")).where(F.col("entry_count") > most)


def fetch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a fetch alone: status, redirects and response time; one pass, one explode."""
    status, ttfb = F.col("status_code"), F.col("ttfb_ms")
    rules = [
        ("status_4xx", "error", status.between(400, 499)),
        ("status_5xx", "error", status.between(500, 599)),
        ("redirect_chain", "warning", F.col("hop_count") > 1),
        ("redirect_loop", "error", F.col("loop")),
        ("redirect_hops_exceeded", "error", F.col("exceeded")),
        ("very_slow_response", "warning", ttfb > VERY_SLOW_MS),
        ("slow_response", "info", ttfb > SLOW_MS),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("issue_type"), F.lit(severity).alias("severity"))) for name, severity, c in rules]))
    return T.fetches(spark, sf_dir).select("fetch_seq", "url_id", F.explode(found).alias("x")).select("fetch_seq", "url_id", "x.issue_type", "x.severity")


#: Severity of each cross-page detector; the columns it gives beside url_id are its details.
DETECTORS = {
    "duplicate_title": ("warning", crawl.duplicate_title),
    "duplicate_description": ("warning", crawl.duplicate_description),
    "duplicate_content": ("warning", crawl.duplicate_content),
    "duplicate_h1": ("warning", crawl.duplicate_h1),
    "duplicate_h2": ("warning", crawl.duplicate_h2),
    "orphan_page": ("warning", crawl.orphan_page),
    "deep_page": ("info", deep_page),
    "hreflang_not_reciprocal": ("warning", hreflang_not_reciprocal),
    "broken_hreflang_target": ("error", broken_hreflang_target),
    "canonical_to_non_200": ("error", crawl.canonical_to_non_200),
    "canonical_chain": ("warning", crawl.canonical_chain),
    "canonical_to_redirect": ("warning", canonical_to_redirect),
    "non_indexable_canonical": ("warning", crawl.non_indexable_canonical),
    "unlinked_canonical": ("warning", crawl.unlinked_canonical),
    "broken_pagination_chain": ("warning", broken_pagination_chain),
    "pagination_canonical_mismatch": ("warning", pagination_canonical_mismatch),
    "sitemap_non_200": ("warning", sitemap_non_200),
    "sitemap_url_redirect_host_mismatch": ("warning", sitemap_url_redirect_host_mismatch),
    "sitemap_url_external_host": ("warning", sitemap_url_external_host),
    "crawled_not_in_sitemap": ("info", crawl.crawled_not_in_sitemap),
    "in_sitemap_not_crawled": ("info", crawl.in_sitemap_not_crawled),
    "in_sitemap_robots_blocked": ("warning", crawl.in_sitemap_robots_blocked),
    "http_to_https_missing": ("info", crawl.http_to_https_missing),
    "js_only_navigation": ("warning", lambda spark, sf_dir: crawl.js_only_navigation(spark, sf_dir).withColumnRenamed("source_id", "url_id")),
    "image_over_100kb": ("warning", image_over_100kb),
    "no_internal_outlinks": ("warning", crawl.no_internal_outlinks),
    "non_indexable_in_sitemap": ("warning", crawl.non_indexable_in_sitemap),
    "url_in_multiple_sitemaps": ("info", crawl.url_in_multiple_sitemaps),
    "sitemap_too_large": ("warning", lambda spark, sf_dir: sitemap_too_large(spark, sf_dir, SITEMAP_ROWS)),
}


def issues(spark: SparkSession, sf_dir: str, values: DataFrame | None = None) -> DataFrame:
    """One table of issues: url_id, issue_type, severity, scope ('page_local' or 'global') and details as JSON.

    All cross-page detectors and the rules on fetches; url_id is null where an issue is a host's or a sitemap's. The rules on
    documents are in page_rules(), which reads the extraction. The five kinds of copies are found together, in ``values`` as
    crawl.page_values() gives them, which are worked out here unless given.
    """
    copies = crawl.later_copies(crawl.page_values(spark, sf_dir) if values is None else values, crawl.COPIES)
    severity = F.coalesce(*[F.when(F.col("kind") == k, DETECTORS[k][0]) for k in crawl.COPIES])
    tables = [copies.select(F.col("url_id").cast("long").alias("url_id"), F.col("kind").alias("issue_type"), severity.alias("severity"), F.lit("global").alias("scope"), F.to_json(F.struct("value", "group_size")).alias("details"))]
    for name, (severity, find) in DETECTORS.items():
        if name in crawl.COPIES:
            continue
        found = find(spark, sf_dir)
        details = F.to_json(F.struct(*[c for c in found.columns if c != "url_id"])) if set(found.columns) != {"url_id"} else F.lit("{}")
        url_id = F.col("url_id").cast("long") if "url_id" in found.columns else F.lit(None).cast("long")
        tables.append(found.select(url_id.alias("url_id"), F.lit(name).alias("issue_type"), F.lit(severity).alias("severity"), F.lit("global").alias("scope"), details.alias("details")))
    local = fetch_rules(spark, sf_dir)
    tables.append(local.select("url_id", "issue_type", "severity", F.lit("page_local").alias("scope"), F.to_json(F.struct("fetch_seq")).alias("details")))
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def issue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue without its details."""
    return issues(spark, sf_dir).select("url_id", "issue_type", "severity", "scope")


def severity_rank(severity):
    return F.when(severity == "error", 1).when(severity == "warning", 2).when(severity == "info", 3).otherwise(4)


def prj_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by type with the rank of their severity."""
    return fetch_rules(spark, sf_dir).groupBy("issue_type", severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))


def topk_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty issues on fetches by severity, type and fetch: the limit is the feature."""
    return fetch_rules(spark, sf_dir).orderBy(severity_rank(F.col("severity")), "issue_type", "fetch_seq").limit(40).select("fetch_seq", "url_id", "issue_type", "severity")


def cluster_url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs, crawled or listed, that are one page under another spelling: those with two spellings or more."""
    every = T.urls(spark, sf_dir).select("url").union(T.sitemap(spark, sf_dir).select("url")).distinct()
    groups = every.groupBy(U.sitemap_key("url").alias("key")).agg(F.count(F.lit(1)).alias("variant_count"), F.min("url").alias("primary_url"))
    return groups.where("variant_count > 1")


def srt_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty clusters of spellings, the largest first, then by URL: the limit is the feature."""
    return cluster_url_variants(spark, sf_dir).orderBy(F.desc("variant_count"), "primary_url").limit(50)


def url_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first segment of their path."""
    return T.urls(spark, sf_dir).groupBy(U.first_segment("url").alias("url_group")).agg(F.count(F.lit(1)).alias("n_urls"), F.countDistinct("host").alias("n_hosts"))


def sitemap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sitemap: rows, distinct keys, and keys that were crawled."""
    known = T.urls(spark, sf_dir).select(U.sitemap_key("url").alias("key")).distinct().withColumn("crawled", F.lit(True))
    listed = T.sitemap(spark, sf_dir).join(known, "key", "left")
    return listed.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("key").alias("keys"), F.countDistinct(F.when(F.col("crawled"), F.col("key"))).alias("crawled_keys"))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links between pages, one a pair, with how many there are and whether a static one is among them."""
    links = T.edges(spark, sf_dir).where("is_internal and relation_type = 'link'")
    return links.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n_links"), F.bool_or(F.col("discovery_mode") == "static").alias("has_static"))


def http_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host: URLs by scheme."""
    return T.urls(spark, sf_dir).groupBy("host").agg(F.count_if(F.col("url").startswith("http://")).alias("http_urls"), F.count_if(F.col("url").startswith("https://")).alias("https_urls"))


def page_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page with what a detail view shows: facts, latest fetch, link counts and number of issues on its URL."""
    p = T.pages(spark, sf_dir).select("url_id", "title", "depth", "word_count", "indexability_state")
    found = crawl.url_rules(spark, sf_dir).groupBy("url_id").agg(F.count(F.lit(1)).alias("url_issues"))
    joined = p.join(_status_of(spark, sf_dir, "url_id"), "url_id", "left").join(crawl.link_counts(spark, sf_dir), "url_id").join(found, "url_id", "left")
    return joined.withColumn("url_issues", F.coalesce("url_issues", F.lit(0)))


def jobs_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each state of URLs: how many, and the share of all."""
    counts = T.urls(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


QUERIES = {f.__name__: f for f in (deep_page, hreflang_not_reciprocal, broken_hreflang_target, canonical_to_redirect, broken_pagination_chain, pagination_canonical_mismatch, sitemap_non_200, sitemap_url_redirect_host_mismatch, sitemap_url_external_host, image_over_100kb, sitemap_too_large, fetch_rules, issue_table, prj_case, topk_examples, cluster_url_variants, srt_clusters, url_groups, sitemap_summary, link_graph, http_hosts, page_bundle, jobs_status)}
