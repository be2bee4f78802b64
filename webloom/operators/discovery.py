"""What pages say about other URLs: typed edges, assets, URL rows by their contents, and the frontier that grows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import scope as S
from webloom.functions import urls as U
from webloom.functions.html import extract
from webloom.sources import tables as T

# Link flags that are kept, and limits of the frontier.
REL_FLAGS = ("nofollow", "ugc", "sponsored", "noopener", "noreferrer")
MAX_DEPTH, MAX_QUERY_VARIANTS = 50, 50


def url_key(url: Column) -> Column:
    """Natural key of a URL that has no row yet: a hash of its normal form."""
    return F.xxhash64(url)


def rel_flags(rel: Column) -> Column:
    """Known flags of a rel attribute, in order and as often as they stand there."""
    return F.filter(F.split(F.lower(F.trim(rel)), "[ \\t\\r\\n\\f]+"), lambda x: x.isin(*REL_FLAGS))


def indexability_state(meta_robots: Column, x_robots_tag: Column) -> Column:
    """'noindex_meta' or 'noindex_header' if one of the comma-separated directives there is noindex (meta first), else 'indexable'."""
    has = lambda c: F.exists(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x) == "noindex")
    return F.when(has(meta_robots), "noindex_meta").when(has(x_robots_tag), "noindex_header").otherwise("indexable")


def edge_build(parsed: DataFrame, is_internal, discovery_mode: str = "static") -> DataFrame:
    """Typed edges of extracted pages: links, canonicals, translations, next and previous pages, images.

    ``is_internal`` makes a column of a URL column. Links with a fragment and links to the page itself
    are left out; so is what leads to no http(s) URL. One row an occurrence, with its place among the
    page's edges (nth). No shuffle: one pass over the extraction and one explode.
    """
    null, none = F.lit(None).cast("string"), F.lit("")
    edge = lambda url, kind, text=none, rel=none, target=none: F.struct(url.alias("declared_target_url"), F.lit(kind).alias("relation_type"), text.alias("anchor_text"), rel.alias("rel"), target.alias("target_attr"))
    every = F.concat(
        F.transform(F.filter("links", lambda x: ~x["url"].rlike("#.")), lambda x: edge(x["url"], "link", x["text"], x["rel"], x["target"])),
        F.array(edge(F.col("canonical_resolved"), "canonical")),
        F.transform("hreflangs", lambda x: edge(x["url"], "hreflang")),
        F.array(edge(F.col("rel_next"), "pagination_next"), edge(F.col("rel_prev"), "pagination_prev")),
        F.transform("images", lambda x: edge(x["src"], "asset_ref")),
    )
    each = parsed.select("url_id", U.normalize("url").alias("_own"), F.posexplode(F.filter(every, lambda e: F.coalesce(e["declared_target_url"], none) != "")).alias("nth", "e")).select("url_id", "_own", "nth", "e.*")
    normal = F.when(~U.dropped_scheme("declared_target_url"), U.normalize("declared_target_url"))
    kept = each.withColumn("target_url", F.coalesce(normal, null)).where("target_url is not null and not (relation_type = 'link' and target_url <=> _own)")
    return kept.select(
        F.col("url_id").alias("source_id"),
        "nth",
        "declared_target_url",
        "target_url",
        url_key(F.col("target_url")).alias("target_key"),
        F.lit("rendered_dom" if discovery_mode == "browser" else "html").alias("source_kind"),
        "relation_type",
        rel_flags(F.col("rel")).alias("rel_flags"),
        F.lit(discovery_mode).alias("discovery_mode"),
        "anchor_text",
        "target_attr",
        is_internal(F.col("target_url")).alias("is_internal"),
    )


def asset_refs(parsed: DataFrame) -> DataFrame:
    """Assets that pages load, images among them, with their normal URLs: one row a page, URL and kind."""
    both = F.concat("assets", F.transform("images", lambda x: F.struct(x["src"].alias("url"), F.lit("image").alias("type"))))
    each = parsed.select("url_id", F.explode(both).alias("x")).select("url_id", U.normalize("x.url").alias("asset_url"), F.col("x.type").alias("kind"))
    return each.where("asset_url is not null").distinct()


def url_rows(edges: DataFrame, known: DataFrame) -> DataFrame:
    """URLs that edges name and that have no row in ``known`` (url): one row each, with its key, host, the kinds of
    edges and the least source that name it.

    Both sides are keyed by the normal URL; what an edge repeats is folded before it is moved.
    """
    named = edges.groupBy(F.col("target_url").alias("url")).agg(F.array_sort(F.collect_set("relation_type")).alias("relations"), F.min("source_id").alias("first_source_id"), F.max("is_internal").alias("is_internal"))
    new = named.join(known.select(U.normalize("url").alias("url")), "url", "left_anti")
    return new.select(url_key(F.col("url")).alias("url_key"), "url", S.hostname(F.col("url")).alias("host"), "relations", "first_source_id", "is_internal")


def edge_frontier(edges: DataFrame, depths: DataFrame, known: DataFrame, max_depth: int = MAX_DEPTH, max_variants: int = MAX_QUERY_VARIANTS, max_urls: int | None = None, ignored: tuple[str, ...] = U.IGNORED_PARAMS) -> DataFrame:
    """URLs to fetch next: targets of internal links that are not known yet, with their least depth.

    ``depths`` has url_id, url and depth of the sources. A URL is compared without ignored parameters. Left out are
    links to the source itself, URLs deeper than ``max_depth``, paths with one segment three times running, and
    of each path all but the first ``max_variants`` query strings (those of known URLs counted first, then by depth and
    URL). With ``max_urls`` the nearest so many are taken, by depth and URL.

    The anti-join makes it incremental: a further call with the found URLs among the known ones gives only new ones. The
    rank per path is limited before the shuffle, so a path with very many variants costs max_variants rows a task.
    """
    links = edges.where("relation_type = 'link' and is_internal").select("source_id", U.frontier_key("target_url", ignored).alias("url"))
    source = depths.select(F.col("url_id").alias("source_id"), U.frontier_key(U.normalize("url"), ignored).alias("own"), (F.col("depth") + 1).alias("depth"))
    found = links.join(source, "source_id").where(F.col("url") != F.col("own")).groupBy("url").agg(F.min("depth").alias("depth"), F.min("source_id").alias("first_source_id"))
    found = found.where((F.col("depth") <= max_depth) & ~U.repeats_segment("url"))
    seen = known.select(U.frontier_key(U.normalize("url"), ignored).alias("url")).distinct()
    new = found.join(seen, "url", "left_anti")
    path = F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^$", "/")
    new, seen = (df.withColumns({"path": path, "query": F.regexp_extract("url", "\\?(.*)$", 1)}) for df in (new, seen))
    old = seen.where("query != ''").select("path", "query").distinct().select("path", "query", F.lit(-1).cast("long").alias("depth"), F.lit("").alias("url"), F.lit(None).cast("long").alias("first_source_id"))
    both = new.where("query != ''").select("path", "query", F.col("depth").cast("long").alias("depth"), "url", "first_source_id").unionByName(old)
    first = F.min(F.struct("depth", "url")).over(Window.partitionBy("path", "query"))
    nth = F.dense_rank().over(Window.partitionBy("path").orderBy("first", "query"))
    allowed = both.withColumn("first", first).withColumn("nth", nth).where(F.col("nth") <= max_variants).where("url != ''")
    columns = ("url", "depth", "first_source_id")
    kept = new.where("query = ''").select(*columns).unionByName(allowed.select(*columns))
    kept = kept.select(url_key(F.col("url")).alias("url_key"), "url", S.hostname(F.col("url")).alias("host"), "depth", "first_source_id")
    return kept if max_urls is None else kept.orderBy("depth", "url").limit(max_urls)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(T.table(spark, sf_dir, "pages"))


def _inside(url: Column) -> Column:
    return S.in_scope(url, "registrable_domain", "www.example.org")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the pages' documents name, the crawl's scope being example.org."""
    e = edge_build(_parsed(spark, sf_dir), _inside)
    return e.select("source_id", "nth", "target_url", "relation_type", "anchor_text", "is_internal", F.size("rel_flags").alias("n_flags"), "source_kind")


def page_url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that pages name and that were not crawled."""
    rows = url_rows(edge_build(_parsed(spark, sf_dir), _inside), T.urls(spark, sf_dir))
    return rows.select("url", "host", F.array_join("relations", ",").alias("relations"), "first_source_id", "is_internal")


def page_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier that the pages' internal links give, sources by their stored depths."""
    depths = T.pages(spark, sf_dir).select("url_id", "url", "depth")
    return edge_frontier(edge_build(_parsed(spark, sf_dir), _inside), depths, T.urls(spark, sf_dir)).drop("url_key")


def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each page and of its main content, with the blocks that its text falls into."""
    p = _parsed(spark, sf_dir)
    blocks = F.size(F.filter(F.split("bounded_text", "​​​"), lambda x: F.trim(x) != ""))
    return p.select("url_id", "word_count", "main_content_word_count", blocks.alias("n_blocks"), "canonical_type", indexability_state(F.col("meta_robots"), F.lit(None).cast("string")).alias("indexability_state"))


def url_registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of the pages' hosts, put under suffixes of all kinds of rules, and whether they share the seed's."""
    ends = ["example.org", "a.co.uk", "b.co.uk", "www.ck", "shop.city.kobe.jp", "shop.kobe.jp", "co.uk"]
    i = F.col("url_id") % len(ends)
    host = F.when(i == 6, "co.uk").when(i == 5, "shop.kobe.jp").otherwise(F.concat(F.substring_index("host", ".", 1), F.lit("."), F.element_at(F.array(*map(F.lit, ends)), (i + 1).cast("int"))))
    hosts = T.urls(spark, sf_dir).select("url_id", host.alias("host"))
    return hosts.select("url_id", "host", S.registrable_domain("host").alias("registrable"), S.in_scope(F.concat(F.lit("https://"), F.col("host"), F.lit(":8443/x")), "registrable_domain", "www.a.co.uk:443").alias("in_scope"))


QUERIES = {f.__name__: f for f in (page_edges, page_url_rows, page_frontier, main_content, url_registrable)}
