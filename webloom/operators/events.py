"""Events of a crawl with JSON details: decoded once to VARIANT, routed by type, and unfolded to audits and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import headers
from webloom.operators import sinks
from webloom.sources import tables as T

# Event types with a place of their own, and the audits whose numeric value is a figure of a page's loading.
KINDS = {"psi_audit": "psi", "axe_audit": "axe", "markdown_negotiation": "markdown", "metric": "metric"}
TIMINGS = {
    "largest-contentful-paint": "lcp",
    "first-contentful-paint": "fcp",
    "cumulative-layout-shift": "cls",
    "total-blocking-time": "tbt",
    "speed-index": "si",
    "server-response-time": "ttfb",
}
CATEGORIES = {"performance": "performance", "accessibility": "accessibility", "best-practices": "best_practices", "seo": "seo"}
#: Keys under which the details of an audit may hold each category's score.
SPELLINGS = {
    "performance": ("performanceScore", "performance"),
    "accessibility": ("accessibilityScore", "accessibility"),
    "best_practices": ("bestPracticesScore", "bestPractices", "best_practices"),
    "seo": ("seoScore", "seo"),
}


def decoded(json: Column) -> Column:
    """A JSON text as VARIANT; null, empty and malformed texts are null."""
    return F.when(json != "", F.try_parse_json(json))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def number(v: Column, path: str) -> Column:
    """The number at a path; null for anything else, a string of digits too."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def text(v: Column, path: str) -> Column:
    """The string at a path; empty for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def split_events(events: DataFrame) -> DataFrame:
    """Events (event_type, details_json and further columns) with their ``kind`` and ``details`` as VARIANT.

    The types of KINDS need an object as details, else the event is left out; every other type,
    null too, is of kind ``event`` and stays, its details null if they can't be read.
    """
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in KINDS.items()], F.lit("event"))
    rows = events.withColumns({"kind": kind, "details": decoded(F.col("details_json"))}).drop("details_json")
    return rows.where((F.col("kind") == "event") | is_object(F.col("details")))


def audit_scores(audits: DataFrame) -> DataFrame:
    """Category scores and loading times of page speed responses (details): 0 where one is missing or no number."""
    v = F.col("details")
    scores = {c: F.coalesce(number(v, f'$.lighthouseResult.categories["{k}"].score'), F.lit(0.0)) for k, c in CATEGORIES.items()}
    times = {c: F.coalesce(number(v, f'$.lighthouseResult.audits["{k}"].numericValue'), F.lit(0.0)) for k, c in TIMINGS.items()}
    return audits.withColumns(scores | times).drop("details")


def audit_rows(audits: DataFrame) -> DataFrame:
    """One row for each audit in a page speed response that has a title or a score over 0: audit, title, description, score, display_value."""
    one = F.explode(F.try_variant_get(F.col("details"), "$.lighthouseResult.audits", "map<string, variant>")).alias("audit", "a")
    rows = audits.select(*[c for c in audits.columns if c != "details"], one).where(is_object(F.col("a")))
    a = F.col("a")
    rows = rows.withColumns({"title": text(a, "$.title"), "description": text(a, "$.description"), "score": F.coalesce(number(a, "$.score"), F.lit(0.0)), "display_value": text(a, "$.displayValue")})
    return rows.where((F.col("title") != "") | (F.col("score") > 0)).drop("a")


def violations(audits: DataFrame) -> DataFrame:
    """One row for each rule that an accessibility audit found violated: rule, impact, n_nodes. An audit that failed has none."""
    v = F.col("details")
    one = F.explode(F.try_variant_get(v, "$.violations", "array<variant>")).alias("v")
    rows = audits.where(text(v, "$.error") == "").select(*[c for c in audits.columns if c != "details"], one).where(is_object(F.col("v")))
    nodes = F.coalesce(F.size(F.try_variant_get("v", "$.nodes", "array<variant>")), F.lit(0))
    return rows.withColumns({"rule": text(F.col("v"), "$.id"), "impact": text(F.col("v"), "$.impact"), "n_nodes": F.greatest(nodes, F.lit(0)).cast("long")}).drop("v")


def audit_means(audits: DataFrame) -> DataFrame:
    """One row: how many audits, and each category's mean over those that have it under any of its spellings (null if none has)."""
    v, columns = F.col("details"), []
    for name, keys in SPELLINGS.items():
        found = [number(v, f"$.{k}") for k in keys]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in found[1:]), F.coalesce(found[0], F.lit(0.0)))
        times = sum((x.isNotNull().cast("int") for x in found[1:]), found[0].isNotNull().cast("int"))
        columns.append((F.sum(total) / F.nullif(F.sum(times), F.lit(0))).alias(f"avg_{name}"))
    return audits.agg(F.count(F.lit(1)).alias("total"), *columns)


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, url_id, details_json: the events table's rows with what each type's event carries, its own properties within."""
    e, i = T.table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    score = lambda n: (i % n).cast("string")
    psi = F.concat(
        F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), score(7), F.lit('},"seo":{"score":"4"},"best-practices":{"score":'), score(5),
        F.lit('}},"audits":{"speed-index":{"title":"Speed","score":'), score(3), F.lit(',"numericValue":'), F.floor("value").cast("string"),
        F.lit('},"empty":{"title":"","score":0},"flat":3,"scored":{"score":'), score(2), F.lit('}}},"performanceScore":'), score(7), F.lit(',"best_practices":'), score(5), F.lit(',"seo":"4","props":'), F.col("props"), F.lit("}"),
    )
    axe = F.concat(F.lit('{"error":"'), F.when(i % 9 == 0, "timeout").otherwise(""), F.lit('","violations":[{"id":"rule-'), score(4), F.lit('","impact":"minor","nodes":[1,2]},{"id":"image-alt","nodes":[]}],"props":'), F.col("props"), F.lit("}"))
    view = F.when(i % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    click = F.when(i % 3 == 0, "").when(i % 3 == 1, F.substring("props", 1, 4)).otherwise(F.col("props"))
    details = F.when(kind == "purchase", psi).when(kind == "signup", axe).when(kind == "error", F.col("props")).when(kind == "view", view).otherwise(click)
    named = F.when(kind == "purchase", "psi_audit").when(kind == "signup", "axe_audit").when(kind == "error", "metric").when(kind == "view", "markdown_negotiation").otherwise("phase")
    return e.select("event_id", named.alias("event_type"), F.col("user_id").alias("url_id"), details.alias("details_json"))


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return split_events(crawl_events(spark, sf_dir)).where(F.col("kind") == kind).select("event_id", "details")


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's kind and its property k, wherever the details hold it."""
    d = F.col("details")
    k = F.coalesce(number(d, "$.k"), number(d, "$.props.k")).cast("long")
    return split_events(crawl_events(spark, sf_dir)).select("event_id", "kind", d.isNotNull().alias("readable"), k.alias("k"))


def src_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_scores(_of(spark, sf_dir, "psi"))


def psi_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(_of(spark, sf_dir, "psi")).select("event_id", "audit", "title", "score")


def src_axe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_of(spark, sf_dir, "axe"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_means(_of(spark, sf_dir, "psi"))


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First element and length of each event's details where they are a JSON array (null length elsewhere)."""
    x = F.col("details_json")
    return crawl_events(spark, sf_dir).select("event_id", F.get_json_object(x, "$[0]").alias("first"), F.json_array_length(x).cast("long").alias("n"))


def snk_purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table, by job, when jobs 2 and 5 of eight go: URLs by job, pages, fetches and assets by URL, hops by fetch."""
    urls = T.urls(spark, sf_dir).select("url_id", (F.col("url_id") % 8).alias("job_id"))
    fetches = T.fetches(spark, sf_dir).select("fetch_seq", "url_id", "hop_count")
    tables = {
        "jobs": urls.select("job_id").distinct(),
        "urls": urls,
        "pages": T.urls(spark, sf_dir).where("status = 'fetched'").select("url_id"),
        "assets": T.assets(spark, sf_dir).select("asset_id", "url_id"),
        "fetches": fetches,
        "hops": fetches.where("hop_count > 0").select("fetch_seq", F.explode(F.sequence(F.lit(1).cast("bigint"), "hop_count")).alias("hop")),
    }
    links = [("urls", "job_id", "jobs", "job_id"), ("pages", "url_id", "urls", "url_id"), ("assets", "url_id", "urls", "url_id"), ("fetches", "url_id", "urls", "url_id"), ("hops", "fetch_seq", "fetches", "fetch_seq")]
    left = sinks.purge_cascade(tables, links, "jobs", F.col("job_id").isin(2, 5))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each relation in the Link header that goes with an event."""
    i = F.col("event_id").cast("string")
    header = F.concat(F.lit("<https://x.example/"), i, F.lit('>; rel="next Prefetch"; title="a, b", bad, <>; rel=x, </s>; REL='), F.col("event_type"))
    link = F.posexplode(headers.link_relations(header)).alias("nth", "link")
    rows = T.table(spark, sf_dir, "events").select("event_id", link)
    return rows.select("event_id", "nth", F.col("link.uri").alias("uri"), F.size("link.params").alias("n_params"), F.explode("link.rels").alias("rel"))


def robots_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content signals in the robots file that goes with a page."""
    i = F.col("page_id")
    text = F.concat(F.lit("User-agent: *\nContent-Signal: search=yes, AI-Train="), F.when(i % 2 == 0, "NO").otherwise("yes"), F.lit(" # all, x=y\nDisallow: /a=b\n content-signal : alone, k = "), i.cast("string"), F.lit("=1\r\n"))
    one = F.posexplode(headers.content_signals(text)).alias("nth", "s")
    return T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), one).select("url_id", "nth", F.col("s.key").alias("signal"), F.col("s.value").alias("value"))


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the Retry-After header that goes with an event asks to wait, in its four forms, and a duration read."""
    i, later = F.col("event_id"), F.col("ts") + F.expr("interval 90 seconds")
    value = F.when(i % 4 == 0, (i % 100).cast("string")).when(i % 4 == 1, F.concat(F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    value = value.when(i % 4 == 2, F.concat(F.date_format(later, "EEEE, dd-MMM-yy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    span = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit("d"))).when(i % 3 == 1, F.concat((i % 50).cast("string"), F.lit("h2m1.5s"))).otherwise("2 h")
    return T.table(spark, sf_dir, "events").select("event_id", headers.retry_after_ms(value, F.col("ts")).alias("wait_ms"), headers.duration_us(span).alias("span_us"))


QUERIES = {f.__name__: f for f in (event_split, src_psi, psi_audits, src_axe, audit_summary, json_arrays, snk_purge_cascade, link_headers, robots_signals, retry_after)}
