"""Filters, sort orders, paging, joins and aggregates of the views over the crawl tables."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.scope import in_scope
from webloom.operators import crawl, findings
from webloom.sources import tables as T


def encode_cursor(key: int) -> str:
    """A page's cursor: its last key in decimal, in base64."""
    return base64.b64encode(str(key).encode()).decode()


def decode_cursor(cursor: str) -> int | None:
    """The key of a cursor; None for an empty one, an error for one that holds no number."""
    return int(base64.b64decode(cursor, validate=True)) if cursor else None


def clamp(limit: int, default: int, most: int) -> int:
    """A page's size: the default for none, at most ``most``."""
    return default if limit <= 0 else min(limit, most)


def next_offset(offset: int, got: int, total: int) -> int | None:
    """Where the next page begins; None after the last."""
    return offset + got if offset + got < total else None


def ordered(df: DataFrame, keys: dict[str, str | Column], sort_by: str, direction: str, last: str) -> DataFrame:
    """df by one of the allowed keys (an unknown name is the last key), ascending unless direction is desc; ties by the last key. Nulls come first, or last where it descends."""
    key = keys.get(sort_by.strip().lower(), last)
    column = F.col(key) if isinstance(key, str) else key
    return df.orderBy(column.desc_nulls_last() if direction.strip().lower() == "desc" else column.asc_nulls_first(), F.col(last).asc())


def offset_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of an ordered view; every row carries the view's total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.offset(max(offset, 0)).limit(limit).crossJoin(F.broadcast(total))  # one row


def page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all that their view sorts and filters by."""
    p = T.pages(spark, sf_dir).select("url_id", "url", "title", "depth", "word_count", "indexability_state")
    counts = crawl.link_counts(spark, sf_dir).select("url_id", "inbound", "outbound")
    found = crawl.url_rules(spark, sf_dir).groupBy("url_id").agg(F.count(F.lit(1)).alias("issues"))
    listed = T.sitemap(spark, sf_dir).select("key").distinct().withColumn("in_sitemap", F.lit(True))
    whole = p.join(counts, "url_id").join(found, "url_id", "left").join(crawl.win_latest(spark, sf_dir).select("url_id", "status_code"), "url_id", "left")
    whole = whole.withColumn("key", U.sitemap_key("url")).join(listed, "key", "left").drop("key")
    return whole.withColumns({"issues": F.coalesce("issues", F.lit(0)), "in_sitemap": F.coalesce("in_sitemap", F.lit(False))})


PAGE_KEYS = {"url": "url", "title": "title", "status": "status_code", "sitemap": "in_sitemap", "depth": "depth", "words": "word_count", "issues": "issues", "inbound": "inbound", "outbound": "outbound"}


def _sorted_pages(key: str, direction: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return offset_page(ordered(page_view(spark, sf_dir), PAGE_KEYS, key, direction, "url_id"), 20, 50).select("url_id", F.col(PAGE_KEYS[key]).alias("sorted_by"), "total")

    return run


def srt_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fetches by response time, slowest first: the limit is the feature."""
    keys = {"status": "status_code", "ttfb": "ttfb_ms"}
    return offset_page(ordered(T.fetches(spark, sf_dir).select("fetch_seq", "status_code", "ttfb_ms"), keys, "ttfb", "DESC", "fetch_seq"), 50, 50)


def srt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of links by target."""
    return offset_page(ordered(findings.link_graph(spark, sf_dir).withColumn("id", F.col("source_id") * 100000000 + F.col("target_id")), {"target": "target_id"}, "target", "", "id"), 0, 100).drop("id")


def srt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of issues on fetches by severity."""
    rows = findings.fetch_rules(spark, sf_dir).withColumn("id", F.concat_ws(":", F.lpad(F.col("fetch_seq").cast("string"), 19, "0"), "issue_type"))
    return offset_page(ordered(rows, {"severity": findings.severity_rank(F.col("severity"))}, "severity", "asc", "id"), 0, 50).select("fetch_seq", "issue_type", "total")


def srt_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of assets by size, largest first."""
    return offset_page(ordered(T.assets(spark, sf_dir), {"size": "content_length"}, "size", "desc", "asset_id"), 0, 100).select("asset_id", "content_length", "total")


def srt_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of sitemap rows by URL."""
    return T.sitemap(spark, sf_dir).select("url", "source").orderBy("url", "source").limit(100)


def srt_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred latest activities: fetches and, as phases, those that failed; newest first, then kind, then id."""
    f = T.fetches(spark, sf_dir)
    fetched = f.select("fetched_at", F.lit("fetch").alias("kind"), F.col("fetch_seq").alias("id"))
    phases = f.where("status_code = 500").select("fetched_at", F.lit("phase").alias("kind"), F.col("fetch_seq").alias("id"))
    return fetched.unionByName(phases).orderBy(F.desc("fetched_at"), "kind", F.desc("id")).limit(100).select("kind", "id")


def flt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(spark, sf_dir).where(F.col("depth").between(2, 4)).select("url_id", "depth")


def flt_default_2xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose latest fetch is of family 2xx, as the view shows them by default."""
    return T.pages(spark, sf_dir).select("url_id").join(crawl.win_latest(spark, sf_dir).where(F.col("status_code").between(200, 299)).select("url_id"), "url_id", "left_semi")


def flt_or_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap rows of which the URL or the source holds a string, in any case."""
    return T.sitemap(spark, sf_dir).where(F.col("url").ilike("%/FR/%") | F.col("source").cast("string").ilike("%4%")).select("url", "source")


def flt_sitemap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap rows, each crawled or not."""
    known = T.urls(spark, sf_dir).where("status = 'fetched'").select(U.sitemap_key("url").alias("key")).distinct().withColumn("known", F.lit(True))
    return T.sitemap(spark, sf_dir).join(known, "key", "left").select("url", "source", F.when(F.col("known"), "in_crawl").otherwise("not_in_crawl").alias("state"))


def ignored_filters(given: dict[str, object], applicable: set[str]) -> list[str]:
    """Names of filters that are set but don't apply to a view."""
    return sorted(k for k, v in given.items() if v not in (None, "", 0, False) and k not in applicable)


def flt_analyzable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches that make a page: 2xx, ended on a host in scope."""
    u = T.urls(spark, sf_dir).select(F.col("url_id").alias("final_id"), "url").where(in_scope("url", "registrable_domain", "example.org"))
    return T.fetches(spark, sf_dir).where(F.col("status_code").between(200, 299)).join(u, "final_id", "left_semi").select("fetch_seq", "url_id")


def flt_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL with whether it is in scope, by the seed's registrable domain, by its host, and by a list of hosts."""
    by = {"by_domain": in_scope("url", "registrable_domain", "m.example.net"), "by_host": in_scope("url", "exact_host", "M.therou.example.com:443"), "by_list": in_scope("url", "allowlist", allowed=("www.cheap-pills.example.com", "spam-farm.example.org"))}
    return T.urls(spark, sf_dir).select("url_id", *[c.alias(n) for n, c in by.items()])


def flt_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches after a watermark."""
    return T.fetches(spark, sf_dir).where("fetch_seq > 900").select("fetch_seq", "url_id")


def flt_force_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose path fits a glob of those to render."""
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", ""), "[?#].*$", "")
    return T.urls(spark, sf_dir).where(U.glob_match(path, "/e?/1*")).select("url_id", "url")


def prj_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the status of its latest fetch, null if there is none."""
    return T.pages(spark, sf_dir).select("url_id").join(crawl.win_latest(spark, sf_dir).select("url_id", "status_code"), "url_id", "left")


def prj_exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_view(spark, sf_dir).select("url_id", "in_sitemap")


def jn_page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every fetch of theirs."""
    return T.pages(spark, sf_dir).select("url_id", "depth").join(T.fetches(spark, sf_dir).select("url_id", "fetch_seq", "status_code"), "url_id")


def jn_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from or to page 5: one scan, one filter."""
    return findings.link_graph(spark, sf_dir).where("source_id = 5 or target_id = 5").select("source_id", "target_id", "n_links")


def jn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every redirected fetch's final page, its own where that was never fetched."""
    f = T.fetches(spark, sf_dir).where("status_code = 301").select("fetch_seq", "final_id", F.col("status_code").alias("own"))
    last = crawl.win_latest(spark, sf_dir).select(F.col("url_id").alias("final_id"), "status_code")
    return f.join(last, "final_id", "left").select("fetch_seq", "final_id", F.coalesce("status_code", "own").alias("status"))


def jn_graph_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of which both ends were fetched."""
    known = T.urls(spark, sf_dir).where("status = 'fetched'").select("url_id")
    links = findings.link_graph(spark, sf_dir)
    return links.join(known.withColumnRenamed("url_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("url_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")


def jn_dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL of every asset's page; ``url:<id>`` where the crawl has none."""
    u = T.urls(spark, sf_dir).where("status = 'fetched'").select("url_id", "url")
    return T.assets(spark, sf_dir).select("asset_id", "url_id").join(u, "url_id", "left").select("asset_id", F.coalesce("url", F.concat(F.lit("url:"), F.col("url_id").cast("string"))).alias("url"))


def jn_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fetches(spark, sf_dir).where(F.col("url_id").isin(1, 3, 5, 8)).select("fetch_seq", "url_id", "status_code")


def agg_group_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.coalesce(F.nullif("indexability_state", F.lit("")), F.lit("unknown"))
    return T.pages(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all clusters of both types."""
    return crawl.cluster_duplicate(spark, sf_dir).agg(F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"))


def agg_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every sitemap key in order, joined by commas; a key has few."""
    return T.sitemap(spark, sf_dir).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), ",").alias("sources"))


def agg_group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(spark, sf_dir).select("source_id", "target_id", "relation_type").distinct()


def agg_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least depth of a page that links to a URL, and one more."""
    p = T.pages(spark, sf_dir).select(F.col("url_id").alias("source_id"), "depth")
    return findings.link_graph(spark, sf_dir).join(p, "source_id").groupBy("target_id").agg(F.min(F.coalesce("depth", F.lit(0)) + 1).alias("depth"))


def agg_counts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of each host by status."""
    u = T.urls(spark, sf_dir).select("url_id", "host")
    return T.fetches(spark, sf_dir).join(u, "url_id").groupBy("host", "status_code").agg(F.count(F.lit(1)).alias("n"))


def agg_avg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means with a denominator each; null where nothing counts."""
    f = T.fetches(spark, sf_dir)
    mean = lambda c: F.round(F.avg(F.when(c, F.col("ttfb_ms"))), 6)
    return f.agg(mean(F.col("status_code") == 200).alias("ok_ms"), mean(F.col("status_code") == 404).alias("missing_ms"), mean(F.col("status_code") == 999).alias("none_ms"))


def agg_scalar_max2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_counts(spark, sf_dir).select("url_id", F.greatest("inbound", "outbound").alias("most"))


def agg_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches a second between the first and the last."""
    span = (F.unix_millis(F.max("fetched_at").cast("timestamp")) - F.unix_millis(F.min("fetched_at").cast("timestamp"))) / 1000.0
    return T.fetches(spark, sf_dir).agg(F.round(F.count(F.lit(1)) / span, 9).alias("rate"))


def win_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with two equal path segments side by side, and those with three."""
    return T.urls(spark, sf_dir).select("url_id", U.repetitive_path("url").alias("twice"), U.repeats_segment("url").alias("thrice"))


def lim_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's preview of sitemap gaps: a hundred at most, the limit being the feature."""
    return crawl.in_sitemap_not_crawled(spark, sf_dir).select("url", "source").orderBy("url", "source").limit(100)


def nxt_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest URL that is still pending."""
    return T.urls(spark, sf_dir).where("status = 'pending'").orderBy("url_id").limit(1).select("url_id", "url")


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised spelling and identity of every URL in the sitemap."""
    return T.sitemap(spark, sf_dir).select("url", U.normalize("url").alias("normalized"), U.identity("url").alias("identity"))


QUERIES = {f.__name__: f for f in (srt_responses, srt_edges, srt_issues, srt_assets, srt_sitemap, srt_activity, flt_range, flt_default_2xx, flt_or_like, flt_sitemap_status, flt_analyzable, flt_scope, flt_activity, flt_force_render, prj_scalar_subquery, prj_exists_flag, jn_page_fetch, jn_or, jn_fallback, jn_graph_both, jn_dim_lookup, jn_in_list, agg_group_expr, agg_sum, agg_group_concat, agg_group_dedup, agg_min_depth, agg_counts_by_key, agg_avg_multi, agg_scalar_max2, agg_rate, win_consecutive, lim_preview, nxt_job, url_normalize)}
QUERIES |= {f"srt_pages_{key}": _sorted_pages(key, "desc" if key in ("words", "issues", "inbound", "outbound", "sitemap") else "asc") for key in PAGE_KEYS}
