"""Crawl scope: registrable domains by public-suffix rules, and which URLs are inside a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import let

# Common public-suffix rules of more than one label, in the published notation: * stands for any label, ! for an
# exception. A label that no rule names is a public suffix by itself. A full list can be given as a table instead.
SUFFIX_RULES = (
    "com.ar", "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "com.br", "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn",
    "com.co", "com.ec", "com.eg", "com.es", "org.es", "com.hk", "org.hk", "co.id", "or.id", "ac.id", "co.il", "org.il", "ac.il", "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "ad.jp", "ed.jp", "gr.jp", "lg.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp",
    "*.sapporo.jp", "!city.sapporo.jp", "*.sendai.jp", "!city.sendai.jp", "*.yokohama.jp", "!city.yokohama.jp", "*.kitakyushu.jp", "!city.kitakyushu.jp",
    "co.ke", "or.ke", "co.kr", "or.kr", "ac.kr", "go.kr", "com.mx", "org.mx", "gob.mx", "edu.mx", "com.my", "org.my", "gov.my", "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz", "geek.nz",
    "com.pe", "com.ph", "com.pk", "com.pl", "net.pl", "org.pl", "edu.pl", "com.pt", "com.py", "com.ru", "com.sa", "com.sg", "org.sg", "edu.sg", "gov.sg", "co.th", "or.th", "ac.th", "go.th", "in.th",
    "com.tr", "org.tr", "gov.tr", "edu.tr", "com.tw", "org.tw", "gov.tw", "edu.tw", "com.ua", "net.ua", "org.ua", "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "ac.uk", "gov.uk", "nhs.uk", "sch.uk",
    "com.uy", "com.ve", "com.vn", "co.za", "org.za", "net.za", "ac.za", "gov.za", "web.za", "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg",
)
MODES = ("registrable_domain", "exact_host", "allowlist")


def _labels(host: Column) -> Column:
    return F.split(F.lower(host), "\\.")


def _bad(host: Column) -> Column:
    return host.isNull() | (host == "") | host.startswith(".") | host.endswith(".") | host.contains("..")


def _tail(labels: Column, n: Column) -> Column:
    """The last n labels; null if there are fewer."""
    return F.when(n <= F.size(labels), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def registrable_domain(host: str | Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    """The public suffix of a host and one label more; null where the host is a suffix itself or no host.

    Of all rules that the host's last labels meet the longest counts, but an exception before any. Each of a host's
    tails is looked up in the rules, so a host costs as many look-ups as it has labels. For rules by the thousands use
    with_registrable_domain().
    """
    host = F.col(host) if isinstance(host, str) else host
    return let(F.when(~_bad(host), _labels(host)), lambda labels: _registrable(labels, rules))


def _registrable(labels: Column, rules: tuple[str, ...]) -> Column:
    kinds = {kind: F.array(*[F.lit(r[skip:]) for r in rules if r.startswith(kind) and (kind or r[0] not in "*!")] or [F.lit(None).cast("string")]) for kind, skip in (("!", 1), ("*.", 2), ("", 0))}

    def length(n):
        """Labels of the suffix that a rule gives, of the tail with n labels."""
        return let(_tail(labels, n), lambda tail: of(n, tail))

    def of(n, tail):
        has = lambda kind, c: F.coalesce(F.array_contains(kinds[kind], c), F.lit(False))
        rest = F.when(n > 1, _tail(labels, n - 1))
        return F.when(has("!", tail), 1000 + n - 1).when(has("", tail) | has("*.", rest), n).otherwise(F.when(n == 1, 1))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(labels)), length))
    return let(best, lambda n: _tail(labels, F.when(n >= 1000, n - 1000).otherwise(n) + 1))


def with_registrable_domain(df: DataFrame, rules: DataFrame, host_col: str = "host", out: str = "registrable_domain") -> DataFrame:
    """df with the registrable domain of a host, by a table of rules (rule: string) of any size.

    The tails of each distinct host are joined with the rules, so what is looked up is one row a host and label.
    """
    hosts = df.select(F.lower(F.col(host_col)).alias("_h")).distinct().where(~_bad(F.col("_h")))
    labels = F.split("_h", "\\.")
    tails = hosts.select("_h", F.size(labels).alias("_size"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_n")).withColumn("_tail", _tail(F.split("_h", "\\."), F.col("_n")))
    kind = F.when(F.col("rule").startswith("!"), 2).when(F.col("rule").startswith("*."), 1).otherwise(0)
    keyed = rules.select(kind.alias("_kind"), F.regexp_replace("rule", "^(!|\\*\\.)", "").alias("_tail")).distinct()
    met = tails.join(keyed, "_tail").withColumn("_length", F.when(F.col("_kind") == 2, 1000 + F.col("_n") - 1).when(F.col("_kind") == 1, F.when(F.col("_n") < F.col("_size"), F.col("_n") + 1)).otherwise(F.col("_n")))
    best = met.groupBy("_h").agg(F.max("_length").alias("_best"))
    n = F.coalesce(F.when(F.col("_best") >= 1000, F.col("_best") - 1000).otherwise(F.col("_best")), F.lit(1)) + 1
    found = hosts.join(best, "_h", "left").select("_h", _tail(labels, n).alias(out))
    return df.join(found, F.lower(F.col(host_col)) == F.col("_h"), "left").drop("_h")


def plain_host(host: str) -> str:
    """A configured host in lower case, without port and brackets."""
    host = host.strip().lower()
    if host.startswith("["):
        return host[1:].split("]")[0]
    return host.rsplit(":", 1)[0] if host.count(":") == 1 else host


def hostname(url: Column) -> Column:
    """Lower-case host of a URL without user, port and brackets."""
    authority = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    return F.lower(F.when(authority.startswith("["), F.regexp_extract(authority, "^\\[([^\\]]*)", 1)).otherwise(F.regexp_replace(authority, ":[0-9]*$", "")))


def in_scope(url: str | Column, mode: str, seed_host: str = "", allowed: tuple[str, ...] = ()) -> Column:
    """Whether a URL belongs to the crawl: http or https, without user, and its host fits.

    'registrable_domain': it has the seed's registrable domain; 'exact_host': it is the seed's host; 'allowlist': it is
    one of those given. Ports and case don't count. A null URL is out of scope.
    """
    url = F.col(url) if isinstance(url, str) else url
    if mode not in MODES:
        raise ValueError(f"unknown scope mode {mode}")
    seed = plain_host(seed_host)
    if mode != "allowlist" and not seed:
        raise ValueError(f"scope mode {mode} needs a seed host")

    def fits(host):
        if mode == "registrable_domain":
            return (host != "") & (registrable_domain(host) == registrable_domain(F.lit(seed)))
        if mode == "exact_host":
            return host == seed
        return host.isin(*sorted(map(plain_host, allowed))) if allowed else F.lit(False)

    sound = url.rlike("^(?i:https?)://[^/?#]") & ~F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1).contains("@")
    return F.coalesce(sound & let(hostname(url), fits), F.lit(False))
