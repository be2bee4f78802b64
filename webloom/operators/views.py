"""Filtered views, keyset and offset pages, report sections, robots rules and write semantics over the crawl tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import crawl
from webloom.sources import tables as T

FAMILIES = {"2xx": (200, 299), "3xx": (300, 399), "4xx": (400, 499), "5xx": (500, 599)}


def status_family(status: Column, family: str) -> Column:
    """Whether a status is of a family; '' and 'all' take every status, an unknown name is an error."""
    name = family.strip().lower()
    low, high = (0, 999) if name in ("", "all") else FAMILIES[name]
    return status.between(low, high)


def page_after(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """Keyset paging: the next ``limit`` rows by key, with has_more; one row more is read to know it."""
    some = df if after is None else df.where(F.col(key) > after)
    rows = some.orderBy(key).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(key))  # over limit + 1 rows
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return rows.withColumns({"_place": place, "has_more": total > limit}).where(F.col("_place") <= limit).drop("_place")


def latest_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the first in the given order: upserts that keep the newest or the first writer."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def robots_pattern(path: Column) -> Column:
    """Regular expression of a robots path pattern: ``*`` is any run, ``$`` at the end anchors, all else is literal."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.left(path, F.length(path) - 1)).otherwise(path)
    parts = F.transform(F.split(body, "\\*"), lambda p: F.regexp_replace(p, r"([\\.\[\]{}()+?^$|])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(anchored, "$").otherwise(""))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (host, path) with allowed: the longest matching pattern holds, allow on a tie, allow where none matches.

    rules: host, rule_type (allow or disallow), path_pattern; empty patterns match nothing.
    """
    told = rules.where("path_pattern != ''").select("host", "path_pattern", (F.col("rule_type") == "allow").alias("allow"), robots_pattern(F.col("path_pattern")).alias("pattern"))
    wanted = paths.select("host", "path").distinct()
    best = wanted.join(told, "host").where(F.regexp_like("path", "pattern")).groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("path_pattern"), F.col("allow"))).alias("allowed"))
    return paths.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, user_agent, rule_type, path_pattern) from host and robots text.

    A group is a run of user-agent lines and the rules after it; rules before any agent are dropped.
    """
    lines = texts.select("host", F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("nth", "line"))
    plain = F.trim(F.regexp_replace("line", "#.*$", ""))
    fields = lines.select("host", "nth", F.lower(F.trim(F.regexp_extract(plain, "^([^:]*):(.*)$", 1))).alias("field"), F.trim(F.regexp_extract(plain, "^([^:]*):(.*)$", 2)).alias("value"))
    fields = fields.where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("nth")
    agent = F.col("field") == "user-agent"
    opens = agent & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = fields.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order)).where("group > 0")
    agents = grouped.where(agent).select("host", "group", F.lower("value").alias("user_agent"))
    told = grouped.where(~agent).select("host", "group", "nth", F.col("field").alias("rule_type"), F.col("value").alias("path_pattern"))
    return agents.join(told, ["host", "group"]).select("host", "user_agent", "rule_type", "path_pattern")


def flt_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that hold a string, in any case."""
    return T.urls(spark, sf_dir).where(F.col("url").ilike("%EXAMPLE.ORG/%")).select("url_id", "url")


def flt_status_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fetches(spark, sf_dir).where(status_family(F.col("status_code"), "4XX")).select("fetch_seq", "url_id", "status_code")


def flt_issue_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an issue on their URL, and how deep they are."""
    return T.pages(spark, sf_dir).select("url_id", "depth").join(crawl.url_rules(spark, sf_dir).select("url_id"), "url_id", "left_semi")


def flt_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs under four robots rules, given to every host that has pages."""
    u = T.urls(spark, sf_dir).select("url_id", "host", F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "").alias("path"))
    four = F.array(*[F.struct(F.lit(kind).alias("rule_type"), F.lit(p).alias("path_pattern")) for kind, p in (("disallow", "/*?"), ("allow", "/*?page="), ("disallow", "/es/"), ("disallow", "/*.html$"))])
    rules = u.select("host").distinct().select("host", F.explode(four).alias("r")).select("host", "r.*")
    return robots_allowed(u, rules).select("url_id", "allowed")


def pg_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty pages after page 20 by key: the limit is the feature."""
    return page_after(T.urls(spark, sf_dir).select("url_id", "status"), "url_id", 20, 50)


def jn_edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links with the URLs of both ends and the target's latest status."""
    u = T.urls(spark, sf_dir).select("url_id", "url")
    links = T.edges(spark, sf_dir).where("is_internal and relation_type = 'link'").select("source_id", "target_id", "discovery_mode").distinct()
    latest = crawl.win_latest(spark, sf_dir).select(F.col("url_id").alias("target_id"), "status_code")
    return links.join(u.select(F.col("url_id").alias("source_id"), F.col("url").alias("source_url")), "source_id").join(u.select(F.col("url_id").alias("target_id"), F.col("url").alias("target_url")), "target_id", "left").join(latest, "target_id", "left")


def agg_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most frequent URL issues with the least page as an example; ties by name."""
    counts = crawl.url_rules(spark, sf_dir).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.min("url_id").alias("example_id"))
    return counts.orderBy(F.desc("n"), "issue_type").limit(10)


def topk_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages with the most links; ties to the smaller page."""
    out = T.edges(spark, sf_dir).where("is_internal and relation_type = 'link'").groupBy("source_id").agg(F.count(F.lit(1)).alias("outbound"))
    return out.orderBy(F.desc("outbound"), "source_id").limit(5)


def agg_count_distinct_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status: fetches, distinct pages, and distinct pages that were slow."""
    f = T.fetches(spark, sf_dir)
    return f.groupBy("status_code").agg(F.count(F.lit(1)).alias("fetches"), F.countDistinct("url_id").alias("pages"), F.countDistinct(F.when(F.col("ttfb_ms") > 1000, F.col("url_id"))).alias("slow_pages"))


def agg_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sitemap key: greatest URL and source."""
    return T.sitemap(spark, sf_dir).groupBy("key").agg(F.max("url").alias("url"), F.max("source").alias("source"), F.count(F.lit(1)).alias("n"))


def agg_worst_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's slowest fetch, the first of equals."""
    f = T.fetches(spark, sf_dir).where("ttfb_ms is not null")
    return f.groupBy("url_id").agg(F.max_by(F.struct("fetch_seq", "ttfb_ms"), F.struct("ttfb_ms", -F.col("fetch_seq"))).alias("x")).select("url_id", "x.fetch_seq", "x.ttfb_ms")


def win_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writer of every frontier key."""
    keyed = T.urls(spark, sf_dir).select("url_id", "discovered_via", U.frontier_key("url").alias("frontier_key"))
    return latest_first(keyed, ["frontier_key"], [F.col("url_id")])


def win_trap_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch at which a status first has been seen on more than 20 pages."""
    first = T.fetches(spark, sf_dir).groupBy("status_code", "url_id").agg(F.min("fetch_seq").alias("fetch_seq"))
    nth = F.row_number().over(Window.partitionBy("status_code").orderBy("fetch_seq"))
    return first.withColumn("nth", nth).where("nth = 21").select("status_code", "fetch_seq", "url_id")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the sitemap that no static link reaches."""
    listed = T.sitemap(spark, sf_dir).select("key").join(T.urls(spark, sf_dir).select("url_id", U.sitemap_key("url").alias("key")), "key").select("url_id").distinct()
    linked = T.edges(spark, sf_dir).where("is_internal and relation_type = 'link' and discovery_mode = 'static'").select(F.col("target_id").alias("url_id"))
    return listed.join(linked, "url_id", "left_anti")


def snk_upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after every fetch was written over the last one of its page and status."""
    return latest_first(T.fetches(spark, sf_dir).select("url_id", "status_code", "fetch_seq", "ttfb_ms"), ["url_id", "status_code"], [F.desc("fetch_seq")])


QUERIES = {f.__name__: f for f in (flt_contains, flt_status_family, flt_issue_presence, flt_robots, pg_cursor, jn_edge_endpoints, agg_topn, topk_outbound, agg_count_distinct_filter, agg_min_max_dedup, agg_worst_per_key, win_first_seen, win_trap_once, set_difference, snk_upsert_update)}
