"""Response headers: parsed snapshots of the security headers, what is missing, the worst of each URL, and the rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import let
from webloom.operators import page_rules
from webloom.sources import tables as T

# The security headers of a snapshot.
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "x-xss-protection", "permissions-policy")


def _value(x: Column) -> Column:
    """A header's value: a string as it is, the strings of a list joined by ', '; anything else is empty."""
    items = F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda y: F.schema_of_variant(y) == "STRING")
    joined = F.array_join(F.transform(items, lambda y: F.variant_get(y, "$", "string")), ", ")
    kind = F.schema_of_variant(x)
    return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.startswith("ARRAY"), joined).otherwise("")


def header_map(headers_json: Column, names: tuple[str, ...]) -> Column:
    """The named headers (lower case) of a JSON object, by name; names it lacks are left out. Null where it is no object.

    Names in the object count without regard to case; of several that are equal then the last holds.
    """
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(headers_json), "$", "map<string,variant>"))

    def pick(e: Column) -> Column:
        named = lambda n: F.try_element_at(F.filter(e, lambda x: F.lower(x["key"]) == n), F.lit(-1))
        found = F.array(*[F.struct(F.lit(n).alias("key"), named(n).alias("at")) for n in names])
        held = F.transform(F.filter(found, lambda x: x["at"].isNotNull()), lambda x: F.struct(x["key"], _value(x["at"]["value"])))
        return F.when(e.isNotNull(), F.map_from_entries(held))

    return let(entries, pick)


def snapshot(headers_json: Column) -> Column:
    """Of each security header whether it is present (not blank) and its value; all are absent where there are no headers."""
    absent = F.create_map()

    def each(held: Column) -> Column:
        value = lambda n: F.coalesce(F.try_element_at(held, F.lit(n)), F.lit(""))
        return F.create_map(*[x for n in SECURITY_HEADERS for x in (F.lit(n), F.struct((F.trim(value(n)) != "").alias("present"), value(n).alias("value")))])

    return let(F.coalesce(header_map(headers_json, SECURITY_HEADERS), absent.cast("map<string,string>")), each)


def missing_names(headers_json: Column) -> Column:
    """How many of the security headers' names stand nowhere in the text of the headers."""
    text = F.lower(F.coalesce(headers_json, F.lit("")))
    return sum((~text.contains(n)).cast("int") for n in SECURITY_HEADERS)


def security_rows(fetches: DataFrame) -> DataFrame:
    """fetches (url, headers_json and others) with headers (the snapshot), n_present and missing_count."""
    seen = fetches.withColumn("headers", snapshot(F.col("headers_json")))
    return seen.withColumns({"n_present": F.size(F.map_filter("headers", lambda _, v: v["present"])), "missing_count": missing_names(F.col("headers_json"))})


def security_figures(fetches: DataFrame) -> DataFrame:
    """One row over the worst fetch of every URL: rows, headers_present, headers_missing, pages_with_issues.

    The worst is a maximum, so a URL with very many fetches is folded before it is moved.
    """
    missing = len(SECURITY_HEADERS) - F.col("n_present")
    worst = security_rows(fetches).groupBy("url").agg(F.max(missing).alias("missing"))
    return worst.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(len(SECURITY_HEADERS) - F.col("missing")), F.lit(0)).alias("headers_present"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("headers_missing"),
        F.count_if(F.col("missing") > 0).alias("pages_with_issues"),
    )


def ordered_security(rows: DataFrame, by: str = "", descending: bool = False) -> DataFrame:
    """Rows by 'url', 'status' or 'missing' (else by fetch), ties by fetch."""
    column = F.col({"url": "url", "status": "status_code", "missing": "missing_count"}.get(by.strip().lower(), "fetch_seq"))
    return rows.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_first(), "fetch_seq")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches with their URL and headers: which are there follows the binary digits of the fetch's number."""
    names = (*SECURITY_HEADERS, "x-robots-tag")
    seq = F.col("fetch_seq")
    value = lambda n: F.when((F.lit(n) == "referrer-policy") & (seq % 7 == 0), '"no-referrer"').when(seq % 3 == 0, '["a", 1, "b"]').when(seq % 5 == 0, '" "').otherwise('"v"')
    each = F.array_compact(F.array(*[F.when(F.floor(seq / 2**i) % 2 == 1, F.concat(F.lit('"'), F.when(seq % 2 == 1, n.upper()).otherwise(n), F.lit('": '), value(n))) for i, n in enumerate(names)]))
    whole = F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))
    text = F.when(seq % 11 == 10, None).when(seq % 11 == 9, "{").otherwise(whole)
    return T.fetches(spark, sf_dir).select("fetch_seq", "url_id", "status_code", text.alias("headers_json")).join(T.urls(spark, sf_dir).select("url_id", "url"), "url_id")


def security_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fetch with its snapshot."""
    rows = security_rows(_fetched(spark, sf_dir))
    return rows.select("fetch_seq", "url_id", "n_present", "missing_count", F.col("headers")["strict-transport-security"]["value"].alias("hsts"), F.col("headers")["referrer-policy"]["value"].alias("referrer_policy"))


def security_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_figures(_fetched(spark, sf_dir))


def srt_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty fetches with the most names missing: the limit is the feature."""
    return ordered_security(security_rows(_fetched(spark, sf_dir)), "missing", True).limit(50).select("fetch_seq", "missing_count")


def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six rules on headers over all fetches, the pages' own directive being noindex."""
    held = _fetched(spark, sf_dir).withColumn("headers", header_map(F.col("headers_json"), (*SECURITY_HEADERS, "x-robots-tag")))
    rules = page_rules.header_rules(F.col("headers"), F.col("url"), F.lit("noindex"))
    return page_rules.detect(held.select(F.col("fetch_seq").alias("url_id"), "url", "headers"), rules).select(F.col("url_id").alias("fetch_seq"), "issue_type", "severity")


QUERIES = {f.__name__: f for f in (security_view, security_summary, srt_security, header_rules)}
