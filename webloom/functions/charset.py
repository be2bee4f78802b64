"""Bodies of responses to text, by the character set that the header or the document names."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: bytes of a document in which its own statement counts.
SNIFFED = 1024
# Browsers read these names as the Windows set that contains them.
_WIDER = {"iso8859-1": "cp1252", "ascii": "cp1252", "iso8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030"}
_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
_PARAM = re.compile(r";\s*charset\s*=\s*\"?([^\s\";]+)", re.IGNORECASE)


def charset_of(body: bytes, content_type: str | None) -> str:
    """Name by the header, else by a meta element near the start; empty if neither has one."""
    found = _PARAM.search(content_type or "")
    if found:
        return found[1]
    meta = _META.search(body[:SNIFFED])
    return meta[1].decode() if meta else ""


def to_text(body: bytes | None, content_type: str | None) -> str | None:
    """The body as text: UTF-8 where no set is named, bad bytes replaced. Null for a null body or an unknown set."""
    if body is None:
        return None
    try:
        name = codecs.lookup(charset_of(body, content_type) or "utf-8").name
        return body.decode(_WIDER.get(name, name), "replace")
    except (LookupError, ValueError):  # ValueError: a name that cannot be one
        return None


def decoded(responses: DataFrame) -> DataFrame:
    """page_id, url and html from page_id, url, body (binary) and content_type: what extract() takes, in one pass without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            html = [to_text(body, kind) for body, kind in zip(b["body"], b["content_type"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "html": pd.Series(html, dtype=object, index=b.index)})

    return responses.select("page_id", "url", "body", "content_type").mapInPandas(run, "page_id long, url string, html string")
