"""Cross-page detectors, link metrics, clusters and summaries over the crawl tables.

Each operator takes (spark, sf_dir), declares its plan with joins on keys and lets the optimizer
choose how to run it; nothing is collected but scalar bounds of views.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.sources import tables as T


#: What copies are told by, for each kind of copy.
COPIES = {"duplicate_title": "title", "duplicate_h1": "h1", "duplicate_content": "content_hash", "duplicate_description": "description", "duplicate_h2": "h2"}


def kept(df: DataFrame) -> DataFrame:
    """df worked out once, its rows in the folder of checkpoints: for narrow rows that take a pass over wide ones and are read again."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint()


def page_values(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """url_id, fetch_seq, the values that copies are told by, and ``more`` of pages(): every document is taken apart once."""
    return kept(T.pages(spark, sf_dir).select("url_id", "fetch_seq", *COPIES.values(), *more))


def later_copies(values: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Of each kind, all but the first member (least fetch_seq) of every group of equal, non-empty values, with the group's size."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()]))
    rows = values.select("url_id", "fetch_seq", each.alias("x")).select("url_id", "fetch_seq", "x.kind", "x.value").where("value != ''")
    groups = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("group_size"), F.min("fetch_seq").alias("first_seq")).where("group_size > 1")
    return rows.join(groups, ["kind", "value"]).where("fetch_seq != first_seq").select("kind", "url_id", "value", "group_size")


def _copies(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    values = kept(T.pages(spark, sf_dir).select("url_id", "fetch_seq", COPIES[kind]))
    return later_copies(values, {kind: COPIES[kind]}).drop("kind")


def duplicate_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, "duplicate_title")


def duplicate_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, "duplicate_h1")


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, "duplicate_content")


def duplicate_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, "duplicate_description")


def duplicate_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir, "duplicate_h2")


def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(spark, sf_dir).where("word_count < 200").select("url_id", "word_count", F.lit(200).alias("threshold"))


def title_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("title")
    issue = F.when(n == 0, "missing_title").when(n > 60, "title_too_long").when(n < 30, "title_too_short")
    return T.pages(spark, sf_dir).select("url_id", issue.alias("issue_type"), n.cast("long").alias("length")).where("issue_type is not null")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(spark, sf_dir).where("is_internal and relation_type = 'link'")


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound links, distinct linking pages and outbound links of every page."""
    links = _links(spark, sf_dir)
    inbound = links.groupBy(F.col("target_id").alias("url_id")).agg(F.count(F.lit(1)).alias("inbound"), F.countDistinct("source_id").alias("linking_pages"))
    outbound = links.groupBy(F.col("source_id").alias("url_id")).agg(F.count(F.lit(1)).alias("outbound"))
    return T.urls(spark, sf_dir).select("url_id").join(inbound, "url_id", "left").join(outbound, "url_id", "left").na.fill(0)


def orphan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _links(spark, sf_dir).select(F.col("target_id").alias("url_id"))
    return T.urls(spark, sf_dir).where("discovered_via != 'seed'").join(linked, "url_id", "left_anti").select("url_id")


def no_internal_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(spark, sf_dir).join(_links(spark, sf_dir).select(F.col("source_id").alias("url_id")), "url_id", "left_anti").select("url_id")


def js_only_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links (source_id, target_id, discovery_mode) that only a browser found: no static link joins the same URLs.

    Targets with a fragment don't count, nor do links to the source's own URL under another spelling.
    """
    static = links.where("discovery_mode = 'static'").select("source_id", "target_id")
    found = links.where("discovery_mode = 'browser'").select("source_id", "target_id").distinct().join(static, ["source_id", "target_id"], "left_anti")
    # normalised before the joins: once a URL, not once a link
    named = lambda df, end: df.select(F.col("url_id").alias(f"{end}_id"), U.normalize("url").alias(f"{end}_key"))
    both = found.join(named(urls.where("not contains(url, '#')"), "target"), "target_id").join(named(urls, "source"), "source_id")
    return both.where(~F.col("source_key").eqNullSafe(F.col("target_key"))).select("source_id", "target_id")


def js_only_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js_only_links(_links(spark, sf_dir), T.urls(spark, sf_dir).select("url_id", "url"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fetches(spark, sf_dir).groupBy("url_id").agg(F.max_by("status_code", "fetch_seq").alias("status_code"), F.max("fetch_seq").alias("fetch_seq"))


def win_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


def canonical_to_non_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir).where("canonical_id != url_id").select("url_id", "canonical_id")
    return p.join(_latest(spark, sf_dir).withColumnRenamed("url_id", "canonical_id"), "canonical_id").where("status_code != 200").select("url_id", "canonical_id", "status_code")


def canonical_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A points to B, B to C, and neither to itself. The view's canonicals end in self, so B is shifted by one page."""
    p = T.pages(spark, sf_dir).select("url_id", (F.col("url_id") - F.col("url_id") % 4 + 1).alias("canonical_id"))
    q = p.select(F.col("url_id").alias("canonical_id"), (F.col("canonical_id") - 1).alias("next_id"))
    return p.join(q, "canonical_id").where("canonical_id != url_id and next_id != canonical_id").select("url_id", "canonical_id", "next_id")


def non_indexable_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    target = p.where("indexability_state != 'indexable'").select(F.col("url_id").alias("canonical_id"), F.col("indexability_state").alias("target_state"))
    return p.where("canonical_id != url_id").select("url_id", "canonical_id").join(target, "canonical_id")


def unlinked_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _links(spark, sf_dir).select(F.col("target_id").alias("canonical_id"))
    return T.pages(spark, sf_dir).where("canonical_id != url_id").select("url_id", "canonical_id").join(linked, "canonical_id", "left_anti")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(spark, sf_dir).select("url_id", "indexability_state", U.sitemap_key("url").alias("key")).join(T.urls(spark, sf_dir).select("url_id", "status"), "url_id")


def crawled_not_in_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).where("indexability_state = 'indexable'").join(T.sitemap(spark, sf_dir).select("key"), "key", "left_anti").select("url_id")


def in_sitemap_not_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sitemap row that matches no URL, or one that is pending."""
    return T.sitemap(spark, sf_dir).join(_keyed(spark, sf_dir), "key", "left").where("url_id is null or status = 'pending'").select("url", "source", "url_id")


def in_sitemap_robots_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sitemap(spark, sf_dir).join(_keyed(spark, sf_dir).where("status = 'robots_blocked'"), "key").select("url", "source", "url_id")


def non_indexable_in_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sitemap(spark, sf_dir).join(_keyed(spark, sf_dir).where("indexability_state != 'indexable'"), "key").select("url", "url_id", "indexability_state")


def url_in_multiple_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sitemap(spark, sf_dir).groupBy("key").agg(F.min("url").alias("url"), F.countDistinct("source").alias("sitemap_count")).where("sitemap_count > 1").select("url", "sitemap_count")


def hosts_without_https(urls: DataFrame, hops: DataFrame) -> DataFrame:
    """Hosts with an http URL (url, host) from none of whose http URLs a redirect (from_url, to_url) leads to https, wherever that is.

    The host of a hop is cut out of its URL, so this is a join by host instead of a comparison of prefixes.
    """
    upgraded = hops.where(F.lower("to_url").startswith("https://")).select(F.lower(F.regexp_extract("from_url", "^(?i:http)://([^/:?#]+)(?:[/:]|$)", 1)).alias("host")).where("host != ''")
    return urls.where("url like 'http://%'").select("host").distinct().join(upgraded, "host", "left_anti")


def http_to_https_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose http URLs are never redirected to https; the hops are the fetches that moved."""
    u = T.urls(spark, sf_dir)
    end = lambda key, name: u.select(F.col("url_id").alias(key), F.col("url").alias(name))
    moved = T.fetches(spark, sf_dir).where("status_code = 301").select("url_id", "final_id").distinct()
    return hosts_without_https(u, moved.join(end("url_id", "from_url"), "url_id").join(end("final_id", "to_url"), "final_id"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the URL alone: one pass, one explode."""
    url = F.col("url")
    path = U.decoded_path(url)
    rules = {"url_uppercase": path.rlike("[A-Z]"), "url_underscores": path.contains("_"), "url_has_parameters": url.rlike("\\?[^#]"), "url_too_long": F.octet_length(url) > 115, "url_multiple_slashes": path.contains("//"), "url_repetitive_path": U.repetitive_path(url), "url_contains_space": U.contains_space(url)}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return T.urls(spark, sf_dir).select("url_id", F.explode(found).alias("issue_type"))


def url_frontier_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.urls(spark, sf_dir).select("url_id", U.frontier_key("url").alias("frontier_key"))


def agg_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fetches(spark, sf_dir).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


def agg_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and 95th percentile by place, from counts of values: the window runs over distinct values, not rows."""
    counts = T.fetches(spark, sf_dir).where("ttfb_ms is not null").groupBy("ttfb_ms").agg(F.count(F.lit(1)).alias("n"))
    run = counts.select("ttfb_ms", F.sum("n").over(Window.orderBy("ttfb_ms")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = lambda k: F.min(F.when(F.col("upto") > k, F.col("ttfb_ms")))
    return run.agg(place(F.floor(F.col("total") / 2)).alias("median_ms"), place(F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1)).alias("p95_ms"))


def win_ring10(spark: SparkSession, sf_dir: str, slow_ms: int = 5000) -> DataFrame:
    """Integer mean of the last ten response times of a host, once ten are there, from slow_ms on."""
    last = Window.partitionBy("host").orderBy("fetch_seq").rowsBetween(-9, 0)
    timed = T.fetches(spark, sf_dir).where("ttfb_ms is not null").join(T.urls(spark, sf_dir).select("url_id", "host"), "url_id")
    ring = timed.select("host", "fetch_seq", F.sum("ttfb_ms").over(last).alias("total"), F.count("ttfb_ms").over(last).alias("n"))
    return ring.where("n = 10").select("host", "fetch_seq", F.floor(F.col("total") / 10).alias("mean_ms")).where(F.col("mean_ms") >= slow_ms)


def slow_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from 500 ms on: the test tables hold no host as slow as the default."""
    return win_ring10(spark, sf_dir, 500)


def cluster_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(spark, sf_dir).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("member_count")).where("member_count > 1")


def cluster_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_clusters(T.pages(spark, sf_dir))


def copy_clusters(pages: DataFrame) -> DataFrame:
    """Groups of pages (url_id, title, content_hash) with equal titles or contents."""
    kinds = pages.select("url_id", F.explode(F.map_from_arrays(F.array(F.lit("title"), F.lit("content")), F.array("title", "content_hash"))).alias("cluster_type", "value"))
    return kinds.where("value != ''").groupBy("cluster_type", "value").agg(F.count(F.lit(1)).alias("member_count"), F.min("url_id").alias("first_id")).where("member_count > 1")


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Set the folder of checkpoints where none is set; on a cluster it has to be a shared one."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="webloom-"))


def levels(spark: SparkSession, links: DataFrame, start: DataFrame) -> DataFrame:
    """Least number of links from any page of ``start`` (url_id) to every page that links reach, level by level."""
    ready_to_checkpoint(spark)
    links = links.select("source_id", "target_id").distinct().checkpoint()
    seen = start.select("url_id", F.lit(0).cast("long").alias("depth")).distinct().checkpoint()
    level = 0
    while True:
        front = seen.where(F.col("depth") == level)
        level += 1
        found = links.join(front, links["source_id"] == front["url_id"]).select(F.col("target_id").alias("url_id")).distinct().join(seen, "url_id", "left_anti")
        found = found.withColumn("depth", F.lit(level).cast("long"))
        grown = seen.union(found).checkpoint()
        if grown.where(F.col("depth") == level).isEmpty():
            return seen
        seen = grown


def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least number of links from page 0 to every page that links reach; page_depths() starts from all seeds."""
    return levels(spark, _links(spark, sf_dir), T.urls(spark, sf_dir).where("url_id = 0"))


def recomputed_depths(spark: SparkSession, pages: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every page (url_id, depth) with its least number of links from any seed; those that no seed reaches keep their depth.

    Seeds and ends of links that are no pages don't count.
    """
    own = pages.select("url_id")
    ends = links.join(own.withColumnRenamed("url_id", "source_id"), "source_id", "left_semi").join(own.withColumnRenamed("url_id", "target_id"), "target_id", "left_semi")
    new = levels(spark, ends, seeds.join(own, "url_id", "left_semi")).withColumnRenamed("depth", "new_depth")
    return pages.join(new, "url_id", "left").select("url_id", F.coalesce("new_depth", F.col("depth").cast("long")).alias("depth"))


def page_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of all pages, recomputed from all seeds."""
    return recomputed_depths(spark, T.pages(spark, sf_dir).select("url_id", "depth"), _links(spark, sf_dir), T.urls(spark, sf_dir).where("discovered_via = 'seed'"))


def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over pages in one pass."""
    p = T.pages(spark, sf_dir)
    return p.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("indexability_state") == "indexable").alias("indexable"),
        F.count_if(F.col("word_count") < 200).alias("thin_pages"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.max("depth").alias("max_depth"),
    )


def srt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hundred of pages by depth (deepest first), then id: offset paging, its limit being the feature."""
    return T.pages(spark, sf_dir).select("url_id", "depth").orderBy(F.desc("depth"), "url_id").offset(100).limit(100)


QUERIES = {f.__name__: f for f in (duplicate_title, duplicate_h1, duplicate_description, duplicate_h2, duplicate_content, thin_content, title_length, link_counts, orphan_page, no_internal_outlinks, js_only_navigation, win_latest, canonical_to_non_200, canonical_chain, non_indexable_canonical, unlinked_canonical, crawled_not_in_sitemap, in_sitemap_not_crawled, in_sitemap_robots_blocked, non_indexable_in_sitemap, url_in_multiple_sitemaps, http_to_https_missing, url_rules, url_frontier_key, agg_group_count, agg_order_statistics, win_ring10, slow_host, cluster_canonical, cluster_duplicate, graph_bfs, page_depths, crawl_summary, srt_pages)}
