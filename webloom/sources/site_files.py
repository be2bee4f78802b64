"""Files that a site keeps for robots: sitemaps (XML, also gzipped, and indexes of them) and llms.txt."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.sources import tables as T

# What is read of one sitemap, and the address pattern and closing marks of llms.txt.
SITEMAP_BYTES = 20 << 20
LLMS_URL, LLMS_CLOSING = "https?://[^\\s<>\")\\]]+", "[.,;:!?]+$"

SITEMAP_SCHEMA = "sitemap_url string, kind string, loc string, lastmod string, changefreq string, priority string"
_FIELDS = ("loc", "lastmod", "changefreq", "priority")


def parse_sitemap(body: bytes | None, url: str, most: int = SITEMAP_BYTES) -> tuple[str, list[dict]]:
    """('index', 'urlset' or 'malformed', entries) of one file; a name that ends in .gz is unpacked, ``most`` bytes are read.

    An index without children is malformed, as is any other root; entries keep the file's order.
    """
    data = (body or b"")[:most]
    try:
        if url.endswith(".gz"):
            data = zlib.decompressobj(wbits=31).decompress(data, most)
        root = ElementTree.fromstring(data)
    except (zlib.error, ElementTree.ParseError):
        return "malformed", []
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    kind, child = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}.get(name(root), ("malformed", ""))
    entries = [{name(x): (x.text or "").strip() for x in e if name(x) in _FIELDS} for e in root if name(e) == child]
    return ("malformed", []) if kind == "index" and not entries else (kind, entries)


def sitemap_rows(files: DataFrame) -> DataFrame:
    """Rows of SITEMAP_SCHEMA from url and body (binary): one an entry, in one pass without a shuffle.

    A file without entries, or a malformed one, has one row with null fields.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, body in zip(batch["url"], batch["body"], strict=True):
                kind, entries = parse_sitemap(body, url or "")
                rows += [{"sitemap_url": url, "kind": kind} | e for e in entries or [{}]]
            yield pd.DataFrame(rows, columns=["sitemap_url", "kind", *_FIELDS]).astype(object).where(lambda d: d.notna(), None)

    return files.select("url", F.col("body").cast("binary").alias("body")).mapInPandas(run, SITEMAP_SCHEMA)


def walk_sitemaps(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (sitemap_url, loc, lastmod, changefreq, priority) of all sitemaps that roots (url) reach through indexes.

    Indexes may name each other: every file counts once. Missing and malformed files are left out.
    """
    spark = files.sparkSession
    crawl.ready_to_checkpoint(spark)
    rows = sitemap_rows(files).checkpoint()
    links = rows.where("kind = 'index'").select(F.col("sitemap_url").alias("source_id"), F.col("loc").alias("target_id"))
    reached = crawl.levels(spark, links, roots.select(F.col("url").alias("url_id"))).select(F.col("url_id").alias("sitemap_url"))
    return rows.where("kind = 'urlset' and loc is not null").join(reached, "sitemap_url", "left_semi").select("sitemap_url", *_FIELDS)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def llms_sections(text: Column) -> Column:
    """array<struct<title, content>> of an llms.txt: a section a line that begins with #, and one without title for what stands before.

    A blank or null text has none.
    """
    pieces = F.split(text, "(?md)^(?=[^\\S\\n]*#)")

    def section(piece: Column) -> Column:
        first = _trimmed(F.substring_index(piece, "\n", 1))
        titled = first.startswith("#")
        rest = F.when(F.instr(piece, "\n") > 0, F.substr(piece, F.instr(piece, "\n") + 1)).otherwise("")
        title = F.when(titled, _trimmed(F.regexp_replace(first, "^#+", ""))).otherwise("")
        return F.struct(title.alias("title"), _trimmed(F.when(titled, rest).otherwise(piece)).alias("content"))

    return F.when(_trimmed(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<struct<title:string,content:string>>")).otherwise(F.transform(pieces, section))


def llms_urls(text: Column) -> Column:
    """Distinct URLs of an llms.txt in order of first appearance, without punctuation at their ends."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LLMS_URL), F.lit(0)), lambda u: F.regexp_replace(u, LLMS_CLOSING, "")))


def src_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the sitemaps of all pages, a file a page, that an index of some hundred names; every tenth is in none."""
    page = T.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "&", "&amp;").alias("u"))
    name = F.concat(F.lit("https://files.example/"), F.col("page_id").cast("string"), F.lit(".xml"))
    around = lambda root, inner: F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), inner, F.lit(f"</{root}>"))
    entry = F.concat(F.lit("<url><loc> "), F.col("u"), F.lit("\n</loc><priority>0.5</priority></url>"))
    own = page.select(name.alias("url"), around("urlset", entry).alias("body"))
    child = F.concat(F.lit("<sitemap><loc>"), name, F.lit("</loc></sitemap>"))
    blocks = page.where("page_id % 10 != 9").groupBy(F.floor(F.col("page_id") / 100).alias("block")).agg(F.concat_ws("", F.collect_list(child)).alias("inner"))
    indexes = blocks.select(F.concat(F.lit("https://files.example/index-"), F.col("block").cast("string"), F.lit(".xml")).alias("url"), around("sitemapindex", F.col("inner")).alias("body"))
    return walk_sitemaps(own.unionByName(indexes), indexes).select("sitemap_url", "loc", "priority")


def src_llms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and URLs of an llms.txt made of every page's URL."""
    text = F.concat(F.lit("about "), F.col("url"), F.lit(".\n# Page "), F.col("page_id").cast("string"), F.lit("\nsee <"), F.col("url"), F.lit("> and http://x.example/a),\n  ## More\n"))
    p = T.table(spark, sf_dir, "pages").select("page_id", llms_sections(text).alias("s"), llms_urls(text).alias("urls"))
    return p.select(F.col("page_id").alias("url_id"), F.posexplode("s").alias("nth", "x"), "urls").select("url_id", "nth", "x.title", "x.content", F.size("urls").alias("n_urls"))


QUERIES = {"src_sitemap": src_sitemap, "src_llms": src_llms}
