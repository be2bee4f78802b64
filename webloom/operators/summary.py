"""The summary of a crawl: one row of counts, means, order statistics, distributions and the most frequent issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import crawl, findings
from webloom.sources import tables as T

# Words under which a page is thin, and how many issue types are shown.
THIN_WORDS, TOP_ISSUES = 200, 10


def _map(key: str, value: str, when: Column) -> Column:
    """Map of the keys and values of the rows that hold; its entries are as many as there are groups."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(key), F.col(value))))))


def page_figures(pages: DataFrame) -> DataFrame:
    """One row from url_id, depth, indexability_state, word_count, has_structured_data, in_sitemap, linked: a single pass.

    Pages are counted by depth and state together; grouping sets over these few counts give both distributions and the
    totals.
    """
    state = F.when(F.coalesce("indexability_state", F.lit("")) == "", "unknown").otherwise(F.col("indexability_state"))
    sums = {
        "n": F.count(F.lit(1)),
        "words": F.sum("word_count"),
        "counted": F.count("word_count"),
        "thin": F.count_if(F.col("word_count") < THIN_WORDS),
        "structured": F.count_if("has_structured_data"),
        "listed": F.count_if("in_sitemap"),
        "orphans": F.count_if(~F.col("linked")),
    }
    counts = pages.groupBy("depth", state.alias("state")).agg(*[c.alias(k) for k, c in sums.items()])
    sets = counts.groupingSets([[F.col("depth")], [F.col("state")], []], "depth", "state").agg(F.grouping_id().alias("set"), *[F.sum(k).alias(k) for k in sums])
    whole = F.col("set") == 3
    total = lambda k: F.coalesce(F.max(F.when(whole, F.col(k))), F.lit(0))
    return sets.agg(
        total("n").alias("total_pages"),
        _map("state", "n", F.col("set") == 2).alias("indexability_distribution"),
        _map("depth", "n", F.col("set") == 1).alias("depth_distribution"),
        F.coalesce(F.max(F.when(whole, F.col("words") / F.col("counted"))), F.lit(0.0)).alias("avg_word_count"),
        total("structured").alias("pages_with_structured_data"),
        total("listed").alias("pages_in_sitemap"),
        total("orphans").alias("orphan_page_count"),
        total("thin").alias("thin_content_count"),
    )


def fetch_figures(fetches: DataFrame) -> DataFrame:
    """One row from status_code, ttfb_ms and fetched_at: a single pass over the fetches.

    They are counted by status and response time; the window that finds places runs over distinct response times.
    """
    counts = fetches.groupBy("status_code", "ttfb_ms").agg(F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("began"), F.max("fetched_at").alias("ended"))
    sets = counts.groupingSets([[F.col("status_code")], [F.col("ttfb_ms")]], "status_code", "ttfb_ms").agg(F.grouping_id().alias("set"), F.sum("n").alias("n"), F.min("began").alias("began"), F.max("ended").alias("ended"))
    timed = (F.col("set") == 2) & F.col("ttfb_ms").isNotNull()
    own = F.when(timed, F.col("n"))
    run = sets.withColumn("upto", F.sum(own).over(Window.orderBy("set", "ttfb_ms"))).withColumn("total", F.sum(own).over(Window.partitionBy()))
    place = lambda k: F.min(F.when(timed & (F.col("upto") > k), F.col("ttfb_ms")))
    seconds = (F.unix_micros(F.max("ended").cast("timestamp")) - F.unix_micros(F.min("began").cast("timestamp"))) / 1e6
    return run.agg(
        _map("status_code", "n", (F.col("set") == 1) & F.col("status_code").isNotNull()).alias("status_code_distribution"),
        F.coalesce(F.sum(F.when(timed, F.col("ttfb_ms") * F.col("n"))) / F.max("total"), F.lit(0.0)).alias("avg_ttfb"),
        F.coalesce(place(F.floor(F.col("total") / 2)), F.lit(0)).cast("double").alias("median_ttfb"),
        F.coalesce(place(F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1)), F.lit(0)).cast("double").alias("p95_ttfb"),
        F.coalesce(seconds, F.lit(0.0)).alias("crawl_duration"),
    )


def issue_figures(issues: DataFrame, pages: DataFrame, urls: DataFrame) -> DataFrame:
    """One row from url_id, issue_type and severity: the issues are counted by all three once, all else is counts of counts.

    Top issues are the types with the most issues, ties by name, each with the URL of its least url_id.
    """
    each = crawl.kept(issues.groupBy("url_id", "issue_type", "severity").agg(F.count(F.lit(1)).alias("n")))  # two uses, one pass
    kinds = each.groupBy("issue_type", "severity").agg(F.sum("n").alias("n"), F.min("url_id").alias("least"))
    sets = kinds.groupingSets([[F.col("issue_type")], [F.col("severity")]], "issue_type", "severity").agg(F.grouping_id().alias("set"), F.sum("n").alias("n"), F.min("least").alias("least"))
    named = sets.join(urls.select(F.col("url_id").alias("least"), F.col("url").alias("example_url")), "least", "left")
    by_type = F.col("set") == 1
    top = F.array_sort(F.collect_list(F.when(by_type, F.struct((-F.col("n")).alias("order"), F.col("issue_type").alias("type"), F.col("n").alias("count"), F.coalesce("example_url", F.lit("")).alias("example_url")))))
    figures = named.agg(
        F.coalesce(F.sum(F.when(by_type, F.col("n"))), F.lit(0)).alias("total_issues"),
        _map("issue_type", "n", by_type).alias("issues_by_type"),
        _map("severity", "n", F.col("set") == 2).alias("issues_by_severity"),
        F.transform(F.slice(top, 1, TOP_ISSUES), lambda x: x.dropFields("order")).alias("top_issues"),
    )
    touched = each.select("url_id").distinct().join(pages.select("url_id"), "url_id", "left_semi").agg(F.count(F.lit(1)).alias("pages_with_issues"))
    return figures.crossJoin(touched)  # one row each


def summarise(pages: DataFrame, urls: DataFrame, fetches: DataFrame, issues: DataFrame, sitemap: DataFrame, links: DataFrame, clusters: DataFrame) -> DataFrame:
    """The 21 figures of a crawl in one row.

    pages: url_id, url, depth, indexability_state, word_count, has_structured_data; urls: url_id, url; fetches: status_code,
    ttfb_ms, fetched_at; issues: url_id, issue_type, severity; sitemap: key; links: target_id of internal links; clusters: member_count.
    Every table is read once (pages twice, for the issues' pages), and what is joined over all rows are the summaries of one row each.
    """
    listed = sitemap.select(F.col("key").alias("_key")).distinct().withColumn("_in", F.lit(True))
    linked = links.select(F.col("target_id").alias("_target")).distinct().withColumn("_linked", F.lit(True))
    keyed = pages.join(linked, F.col("url_id") == F.col("_target"), "left").join(listed, U.sitemap_key("url") == F.col("_key"), "left")
    facts = keyed.select("depth", "indexability_state", "word_count", "has_structured_data", F.coalesce("_in", F.lit(False)).alias("in_sitemap"), F.coalesce("_linked", F.lit(False)).alias("linked"))
    one = page_figures(facts).crossJoin(fetch_figures(fetches)).crossJoin(issue_figures(issues, pages, urls))
    one = one.crossJoin(urls.agg(F.count(F.lit(1)).alias("total_urls"))).crossJoin(clusters.agg(F.coalesce(F.sum("member_count"), F.lit(0)).alias("duplicate_content_count")))
    return one.withColumn("pages_per_second", F.when(F.col("crawl_duration") > 0, F.col("total_pages") / F.col("crawl_duration")).otherwise(0.0))


def _text(c: str) -> Column:
    return F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("string"))), ",").alias(c)


def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the crawl; distributions as key=count, by key."""
    structured = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), F.col("html").contains("application/ld+json").alias("has_structured_data"))
    values = crawl.page_values(spark, sf_dir, "url", "depth", "indexability_state", "word_count")
    pages = values.select("url_id", "url", "depth", "indexability_state", "word_count").join(structured, "url_id")
    links = T.edges(spark, sf_dir).where("is_internal and relation_type = 'link'")
    one = summarise(pages, T.urls(spark, sf_dir), T.fetches(spark, sf_dir), findings.issues(spark, sf_dir, values), T.sitemap(spark, sf_dir), links, crawl.copy_clusters(values))
    maps = ("issues_by_type", "issues_by_severity", "indexability_distribution", "status_code_distribution", "depth_distribution")
    rounded = ("avg_ttfb", "avg_word_count", "pages_per_second", "crawl_duration")
    rest = [c for c in one.columns if c not in (*maps, *rounded, "top_issues")]
    top = F.array_join(F.transform("top_issues", lambda x: F.concat_ws(" ", x["type"], x["count"].cast("string"), x["example_url"])), ",")
    return one.select(*rest, *map(_text, maps), *[F.round(c, 6).alias(c) for c in rounded], top.alias("top_issues"))


QUERIES = {"crawl_report": crawl_report}
