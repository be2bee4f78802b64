"""Values of headers and directives, taken apart with native functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import let

# Names of weekdays as HTTP dates have them, and units of durations in microseconds.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}

_NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_UNIT = "(?:ns|us|µs|μs|ms|s|m|h)"


def link_relations(header: Column) -> Column:
    """array<struct<uri, params array<struct<name, value>>, rels array<string>>> of a Link header.

    Items are parted at commas outside quotes; those that don't begin with a URI in angle brackets
    are left out. Names and relations are lower-cased, parameters without ``=`` left out. A null
    header has none.
    """
    items = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit('(?:[^",]|"[^"]*"?)+'), F.lit(0))
    linked = F.filter(items, lambda x: x.rlike(r"^\s*<[^>]+>"))

    def relation(item):
        fields = F.filter(F.split(F.regexp_replace(item, r"^\s*<[^>]+>", ""), ";"), lambda x: x.contains("="))
        param = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("name"), F.btrim(F.trim(F.regexp_replace(x, "^[^=]*=", "")), F.lit('"')).alias("value"))

        def whole(params):
            named = F.filter(params, lambda p: p["name"] == "rel")
            rels = F.flatten(F.transform(named, lambda p: F.regexp_extract_all(F.lower(p["value"]), F.lit(r"\S+"), F.lit(0))))
            return F.struct(F.regexp_extract(item, r"^\s*<([^>]+)>", 1).alias("uri"), params.alias("params"), rels.alias("rels"))

        return let(F.transform(fields, param), whole)

    return F.transform(linked, relation)


def content_signals(robots: Column) -> Column:
    """array<struct<key, value>> of the Content-Signal lines of a robots file, lower-cased, in order; comments and items without ``=`` left out."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "#.*", ""))
    named = F.filter(lines, lambda x: x.rlike(r"(?i)^\s*content-signal\s*:"))
    items = F.flatten(F.transform(named, lambda x: F.split(F.regexp_replace(x, "^[^:]*:", ""), ",")))
    clean = lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.transform(F.filter(items, lambda x: x.contains("=")), lambda x: F.struct(clean(F.substring_index(x, "=", 1)).alias("key"), clean(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait by a Retry-After header: seconds, or until a date of RFC 1123 or RFC 850 (as GMT, like ``now``).

    0 for null, past dates, seconds under 1 and everything else. Years of two digits from 69 on are
    of the last century.
    """
    days = "|".join(d[:3] for d in WEEKDAYS), "|".join(WEEKDAYS)
    new, old = rf"^(?:{days[0]}), ([0-9]{{2}}) ([A-Z][a-z]{{2}}) ([0-9]{{4}}) ([0-9:]{{8}}) [A-Z]{{3,4}}$", rf"^(?:{days[1]}), ([0-9]{{2}})-([A-Z][a-z]{{2}})-([0-9]{{2}}) ([0-9:]{{8}}) [A-Z]{{3,4}}$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(value, new, k), F.lit("")), F.regexp_extract(value, old, k))
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) >= "69", "19").otherwise("20"), part(3))).otherwise(part(3))
    at = F.try_to_timestamp(F.concat(year, F.lit(" "), part(2), F.lit(" "), part(1), F.lit(" "), part(4)), F.lit("yyyy MMM dd HH:mm:ss"))
    seconds = F.when(value.rlike(r"^\+?[0-9]{1,12}$"), F.try_to_number(F.regexp_replace(value, r"^\+", ""), F.lit("999999999999")).cast("long") * 1000)
    until = F.timestamp_diff("MILLISECOND", now.cast("timestamp"), at)
    return F.greatest(F.lit(0).cast("long"), F.coalesce(seconds, until, F.lit(0).cast("long")))


def duration_us(value: Column) -> Column:
    """Microseconds of ``30d`` or of numbers with units such as ``-2h30m1.5s``; null for anything else, and for more days than a long holds."""
    days = F.try_multiply(F.regexp_extract(value, "^([0-9]+)d$", 1).try_cast("long"), F.lit(86_400_000_000))
    parts = F.regexp_extract_all(value, F.lit(f"{_NUMBER}{_UNIT}"), F.lit(0))
    unit = lambda p: F.coalesce(*[F.when(F.regexp_extract(p, f"({_UNIT})$", 1) == u, F.lit(float(n))) for u, n in UNITS.items()])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.regexp_extract(p, f"^({_NUMBER})", 1).cast("double") * unit(p))
    signed = F.round(total).cast("long") * F.when(value.startswith("-"), -1).otherwise(1)
    return F.when(value.rlike("^[0-9]+d$"), days).when(value.rlike("^[+-]?0$"), F.lit(0).cast("long")).when(value.rlike(f"^[+-]?(?:{_NUMBER}{_UNIT})+$"), signed)
