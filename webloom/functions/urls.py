"""URL expressions, built from native functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), the value being worked out once: the optimizer would copy it to every place where it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def host(url: str | Column) -> Column:
    """Lower-case host of an http(s) URL, without port; empty if there is none."""
    return F.lower(F.regexp_extract(_col(url), "^[A-Za-z]+://([^/:?#]+)", 1))


def sitemap_key(url: str | Column) -> Column:
    """Key under which sitemap and crawled URLs compare: no scheme, no www., lower case, no slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(url)), "^https?://(www\\.)?", ""), "/+$", "")


def _path(url: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(url), "^[A-Za-z]+://[^/?#]*", ""), "[?#].*$", "")


def repeats_segment(url: str | Column) -> Column:
    """Whether a path has one segment three times running, as crawl traps do."""
    return _path(url).rlike("(?:^|/)([^/]+)(?:/\\1){2}(?:/|$)")


def repetitive_path(url: str | Column) -> Column:
    """Whether a path has two equal segments side by side."""
    return _path(url).rlike("(?:^|/)([^/]+)/\\1(?:/|$)")


def contains_space(url: str | Column) -> Column:
    """Whether a URL holds an encoded space: %20 anywhere, or + in path or query."""
    rest = F.regexp_replace(F.regexp_replace(_col(url), "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "")
    return _col(url).contains("%20") | rest.contains("+")


def query_params(url: str | Column) -> Column:
    """Names of query parameters, in order."""
    query = F.regexp_extract(_col(url), "\\?([^#]*)", 1)
    return F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), lambda p: p != "")


# Query parameters that the frontier ignores; a star stands for any ending.
IGNORED_PARAMS = ("utm_*", "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "mc_cid", "mc_eid")
# Schemes that are no pages.
DROPPED_SCHEMES = ("ftp", "mailto", "javascript", "tel", "data", "blob", "file", "gopher", "dict", "ldap", "ldaps", "sftp")


def frontier_key(url: str | Column, ignored: tuple[str, ...] = IGNORED_PARAMS) -> Column:
    """The URL without fragment and without ignored parameters; the other parameters keep their order."""
    plain = F.regexp_replace(_col(url), "#.*$", "")
    base, query = F.regexp_replace(plain, "\\?.*$", ""), F.regexp_extract(plain, "\\?(.*)$", 1)
    names = "^(" + "|".join(p.replace("*", "[^=]*") for p in ignored) + ")(=|$)"
    rest = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(names) & (p != "")), "&")
    return F.when(rest == "", base).otherwise(F.concat(base, F.lit("?"), rest))


def decoded_path(url: str | Column) -> Column:
    """The path with percent codes decoded (as it stands, where they are no UTF-8)."""
    path = _path(url)
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _escapes(text: Column, unreserved: bool) -> Column:
    """Percent codes in upper case; with ``unreserved``, those of letters, digits and -._~ decoded."""
    parts = F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))

    def one(p):
        code = F.upper(p)
        if not unreserved:
            return F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), code).otherwise(p)
        char = F.decode(F.unhex(F.substring(code, 2, 2)), "ISO-8859-1")
        return F.when(~p.rlike("^%[0-9A-Fa-f]{2}$"), p).when(char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(code)

    return F.array_join(F.transform(parts, one), "")


def normalize(url: str | Column) -> Column:
    """Scheme and host in lower case, no default port, path of / at least, percent codes unified, no fragment; null if it is no http(s) URL."""
    return let(F.regexp_replace(F.trim(_col(url)), "[\\x00-\\x1F\\x7F]", ""), _normal)


def _normal(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1), "^[^@]*@", "")
    path, query = _path(u), F.regexp_extract(u, "^[^?#]*\\?([^#]*)", 1)

    def whole(scheme, authority):
        name = F.lower(F.regexp_extract(authority, "^(\\[[^\\]]*\\]|[^:]*)", 1))
        port = F.regexp_extract(authority, ":([0-9]+)$", 1)
        kept = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
        rest = F.concat(let(path, lambda p: F.when(p == "", "/").otherwise(_escapes(p, True))), let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), _escapes(q, False)))))
        return F.when(scheme.isin("http", "https") & (name != ""), F.concat(scheme, F.lit("://"), name, kept, rest))

    return let(F.struct(scheme.alias("s"), authority.alias("a")), lambda x: whole(x["s"], x["a"]))


def identity(url: str | Column) -> Column:
    """Key under which variants of one page meet: normalised, no www. label, no slash at the path's end."""
    n = F.regexp_replace(normalize(url), "^(https?://)www\\.", "$1")
    return F.regexp_replace(n, "^(https?://[^/?]+/[^?]*[^/?])/+(?=$|\\?)", "$1")


def dropped_scheme(url: str | Column) -> Column:
    """Whether a link leads to no page by its scheme; tabs, line ends and NULs inside it don't count."""
    bare = F.regexp_replace(F.trim(_col(url)), "[\\t\\n\\r\\x00]", "")
    return F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*DROPPED_SCHEMES)


def first_segment(url: str | Column) -> Column:
    """First non-empty segment of the path; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.split(_path(url), "/"), lambda p: p != ""), F.lit(0)), F.lit(""))


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a path fits a glob: * is any run without a slash, ? one character but a slash, [..] a class."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    body = "".join(parts.get(c, c if c in "[]-" else "\\" + c if not c.isalnum() else c) for c in pattern)
    return path.rlike(f"^{body}$")
