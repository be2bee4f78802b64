"""HTML documents to rows: one Arrow-batched pass, no shuffle.

The standard library's tokenizer reads the markup; head and body are told apart as browsers do it:
the head ends at its end tag, at ``<body>``, or at the first element or text that no head may hold.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.functions.structured import validate

# Elements by what they do to text and to the head.
HEAD_ONLY = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
HIDDEN = {"script", "style", "noscript"}
SPA_ROOTS = {"root", "__next", "app", "__nuxt"}
NO_LINK = ("javascript:", "mailto:", "tel:", "data:", "blob:")
FLOW_IN_HEAD = {"div", "span", "p", "section", "article", "main", "footer", "header", "nav"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSE_P = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
# what a start tag ends (elements, and the nearest ones beyond which none is ended)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
P_BARRIERS = {"td", "th", "table", "button", "caption", "object", "template"}
BLOCKS = HEADINGS | {"p", "div", "section", "article", "main", "li", "td", "th", "blockquote", "figcaption", "header", "footer", "nav", "aside"}
BESIDE_MAIN = {"nav", "header", "footer", "aside"}
BOUNDARY = "\u200b\u200b\u200b"
NO_ASSET = ("data:", "blob:", "javascript:")
ICONS = {"icon", "apple-touch-icon", "apple-touch-icon-precomposed"}
PATH_SIGNS = "%!$&'()*+,;=:@[]/-._~"

SCHEMA = """url_id long, url string, title string, title_count int, meta_description string, meta_description_count int,
meta_robots string, canonical_raw string, canonical_resolved string, canonical_count int, canonical_outside_head boolean,
rel_next string, rel_prev string, hreflangs array<struct<lang:string,url:string>>, h1 array<string>, h2 array<string>,
first_heading_level int, og map<string,string>, twitter map<string,string>, jsonld_count int, jsonld_types array<string>,
jsonld_malformed boolean,
structured array<struct<type:string,missing_required:array<string>,missing_recommended:array<string>,nested:boolean>>, links array<struct<url:string,text:string,rel:string,target:string>>, image_count int,
alt_missing int, alt_empty int, alt_too_long int, images_without_size int, has_favicon boolean, script_count int,
has_spa_root boolean, text string, word_count int, content_hash string, js_suspect boolean, title_outside_head boolean,
description_outside_head boolean, robots_outside_head boolean, hreflang_outside_head boolean,
insecure_forms array<string>, protocol_relative_count int, h1_alt_only array<string>, invalid_in_head array<string>,
head_count int, body_count int, n_bytes long, h3 array<string>, h4 array<string>, h5 array<string>, h6 array<string>, canonical_type string,
main_content_word_count int, bounded_text string, assets array<struct<url:string,type:string>>,
images array<struct<src:string,alt:string,alt_empty:boolean,alt_missing:boolean,has_width:boolean,has_height:boolean>>,
jsonld array<struct<raw:string,type:string,malformed:boolean>>"""


class _Page(HTMLParser):
    """Facts of one document, gathered while its tags go by."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.in_body, self.hidden = url, False, 0
        self.seen: dict = {"title_count": 0, "meta_description_count": 0, "canonical_count": 0, "jsonld_count": 0, "image_count": 0, "alt_missing": 0, "alt_empty": 0, "alt_too_long": 0, "images_without_size": 0, "script_count": 0, "protocol_relative_count": 0, "head_count": 0, "body_count": 0}
        self.flags = dict.fromkeys(("canonical_outside_head", "jsonld_malformed", "has_favicon", "has_spa_root", "title_outside_head", "description_outside_head", "robots_outside_head", "hreflang_outside_head"), False)
        self.first: dict = {}
        self.og: dict = {}
        self.twitter: dict = {}
        self.hreflangs: list = []
        self.headings: list = []
        self.links: list = []
        self.forms: list = []
        self.types: list = []
        self.blocks: list = []
        self.text: list = []
        self.alt_only: list = []
        self.in_head: list = []  # flow elements met between head's tags
        self.head_open = False
        self.alt: str | None = None  # last alternative text inside the h1 that is open
        self.open: list = []  # (element, attributes, pieces of text) whose text is gathered
        self.tree: list = []  # open elements of the body: (element, whether it is main content)
        self.mains = self.asides = self.media = 0  # open regions
        self.has_main, self.main_words, self.other_words = False, 0, 0
        self.pending: list = []  # text since the last tag
        self.bounds: list = []  # visible text with marks where blocks begin and end
        self.assets: list = []
        self.images: list = []
        self.jsonld: list = []

    def _enter(self, tag, a):
        """Push an element, after ending those that its start tag ends."""
        if tag in CLOSE_P:
            self._end({"p"}, P_BARRIERS)
        if tag in ENDS:
            self._end(*ENDS[tag], every=True)
        if tag in VOID:
            return
        main = tag in ("main", "article") or a.get("role") == "main"
        self.tree.append((tag, main))
        self.mains += main
        self.has_main |= main
        self.asides += tag in BESIDE_MAIN
        self.media += tag in ("video", "audio")
        if tag in BLOCKS:
            self.bounds.append(BOUNDARY)

    def _leave(self, at):
        """Take the element at a place out of the open ones."""
        tag, main = self.tree.pop(at)
        self.mains -= main
        self.asides -= tag in BESIDE_MAIN
        self.media -= tag in ("video", "audio")
        if tag in BLOCKS:
            self.bounds.append(BOUNDARY)

    def _end(self, tags, barriers, every=False):
        """End the innermost of the elements (or all of them) within the barriers, with what it holds."""
        found = None
        for at in range(len(self.tree) - 1, -1, -1):
            if self.tree[at][0] in barriers:
                break
            if self.tree[at][0] in tags:
                found = at
                if not every:
                    break
        while found is not None and len(self.tree) > found:
            self._leave(-1)

    def _exit(self, tag):
        """An end tag: formatting elements end alone, others with what they hold; inline ones don't end blocks."""
        for at in range(len(self.tree) - 1, -1, -1):
            name = self.tree[at][0]
            if name == tag:
                if tag in FORMATTING:
                    self._leave(at)
                else:
                    while len(self.tree) > at:
                        self._leave(-1)
                return
            if tag not in FORMATTING and tag not in CLOSE_P and name in CLOSE_P and tag not in ("li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "table", "video", "audio"):
                return

    def _asset(self, url, kind):
        url = url.strip()
        if url and not url.lower().startswith(NO_ASSET):
            self.assets.append({"url": self._resolved(url), "type": kind})

    def _flush(self):
        """Text since the last tag as one piece."""
        if self.pending:
            data, self.pending = "".join(self.pending), []
            n = len(data.split())
            self.text.append(data)
            self.bounds += (data, " ")
            self.main_words += n * self.mains
            self.other_words += n * (not self.asides)

    def handle_comment(self, data):
        self._flush()

    def _relative(self, value: str) -> None:
        self.seen["protocol_relative_count"] += value.strip().startswith("//")

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")  # of repeated attributes the first holds
        self._flush()
        if tag == "body" or tag not in HEAD_ONLY:
            self.in_body = True
        if tag in ("head", "body"):
            self.seen[f"{tag}_count"] += 1
            self.head_open = tag == "head"
        elif self.head_open and tag in FLOW_IN_HEAD and tag not in self.in_head:
            self.in_head.append(tag)
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden and tag not in HEAD_ONLY and tag != "body":
            self._enter(tag, a)
        if a.get("id") in SPA_ROOTS:
            self.flags["has_spa_root"] = True
        if tag == "title" or tag in HEADINGS or tag == "a" or tag == "script":
            if tag == "a":
                self._close("a")
            self.open.append((tag, a, []))
        if tag == "title":
            self.seen["title_count"] += 1
            self.flags["title_outside_head"] |= self.in_body
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link(a)
        elif tag == "script":
            self.seen["script_count"] += 1
            self._relative(a.get("src", ""))
            self._asset(a.get("src", ""), "script")
        elif tag == "img":
            self._image(a)
        elif tag in ("video", "audio"):
            self._asset(a.get("src", ""), tag)
        elif tag == "source" and self.media:
            self._asset(a.get("src", ""), next(name for name, _ in reversed(self.tree) if name in ("video", "audio")))
        elif tag == "form" and a.get("action", "").strip().lower().startswith("http://"):
            self.forms.append(a["action"].strip())

    def handle_startendtag(self, tag, attrs):
        # a slash at the end of a start tag means nothing in HTML
        self.handle_starttag(tag, attrs)

    def _meta(self, a):
        name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
        if name == "description":
            self.seen["meta_description_count"] += 1
            self.flags["description_outside_head"] |= self.in_body
            self.first.setdefault("meta_description", content)
        elif name == "robots":
            self.flags["robots_outside_head"] |= self.in_body
            self.first.setdefault("meta_robots", content)
        elif name.startswith("twitter:"):
            self.twitter.setdefault(name[8:], content)
        if prop.startswith("og:"):
            self.og.setdefault(prop[3:], content)

    def _link(self, a):
        rel, href = a.get("rel", "").lower().split(), a.get("href", "")
        self._relative(href)
        if "canonical" in rel:
            self.seen["canonical_count"] += 1
            self.flags["canonical_outside_head"] |= self.in_body
            self.first.setdefault("canonical_raw", href.strip())
        if "icon" in rel:
            self.flags["has_favicon"] = True
        if "stylesheet" in rel:
            self._asset(href, "stylesheet")
        elif ICONS & set(rel):
            self._asset(href, "icon")
        elif "preload" in rel:
            self._asset(href, "font" if a.get("as", "").strip().lower() == "font" else "preload")
        for way in ("next", "prev"):
            if way in rel:
                self.first[f"rel_{way}"] = self._resolved(href)  # the last one holds
        if "alternate" in rel and "hreflang" in a:
            self.flags["hreflang_outside_head"] |= self.in_body
            if a["hreflang"] and href:
                self.hreflangs.append({"lang": a["hreflang"], "url": self._resolved(href)})

    def _image(self, a):
        if a.get("alt") and any(tag == "h1" for tag, _, _ in self.open):
            self.alt = a["alt"]
        if not a.get("src", "").strip():
            return
        self._relative(a["src"])
        self.images.append({"src": self._resolved(a["src"]), "alt": a.get("alt", ""), "alt_empty": a.get("alt") == "", "alt_missing": "alt" not in a, "has_width": bool(a.get("width")), "has_height": bool(a.get("height"))})
        self.seen["image_count"] += 1
        self.seen["alt_missing"] += "alt" not in a
        self.seen["alt_empty"] += "alt" in a and not a["alt"].strip()
        self.seen["alt_too_long"] += len(a.get("alt", "").encode()) > 100
        self.seen["images_without_size"] += "width" not in a and "height" not in a

    def _resolved(self, href: str) -> str:
        """The absolute URL of a reference, with what no URL may hold as percent codes in its path."""
        try:
            url = urljoin(self.url, href.strip())
            if url.isascii() and not any(c in url for c in ' "<>\\^`{|}'):
                return url
            parts = urlsplit(url)
            return parts._replace(path=quote(parts.path, safe=PATH_SIGNS, errors="replace"), fragment=quote(parts.fragment, safe=PATH_SIGNS + "?", errors="replace")).geturl()
        except ValueError:  # not a URL at all
            return ""

    def _canonical_type(self, canonical: str) -> str:
        """'self' if it is the page's URL but for slashes at the path's end, else 'cross', or 'absent'."""

        def bare(url):
            try:
                parts = urlsplit(url)
            except ValueError:
                return url
            return parts._replace(path=parts.path.rstrip("/") or "/").geturl()

        return "absent" if not canonical else "self" if bare(canonical) == bare(self._resolved(self.url)) else "cross"

    def _close(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, a, pieces = self.open.pop(k)
                self._done(tag, a, "".join(pieces))
                return

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_body, self.head_open = True, False
        self._flush()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        elif not self.hidden:
            self._exit(tag)
        self._close(tag)

    def _done(self, tag, a, text):
        if tag == "title":
            self.first.setdefault("title", text.strip())
        elif tag in HEADINGS:
            self.headings.append((int(tag[1]), text.strip()))
            if tag == "h1":
                if not text.strip() and self.alt:
                    self.alt_only.append(self.alt)
                self.alt = None
        elif tag == "a":
            href = a.get("href", "").strip()
            self._relative(href)
            if href and href != "#" and not href.lower().startswith(NO_LINK):
                self.links.append({"url": self._resolved(href), "text": text.strip(), "rel": a.get("rel", "").lower(), "target": a.get("target", "").lower()})
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.seen["jsonld_count"] += 1
            self.blocks.append(text)
            before = len(self.types)
            try:
                self._gather_types(json.loads(text))
                self.jsonld.append({"raw": text.strip(), "type": ", ".join(self.types[before:]), "malformed": False})
            except (ValueError, RecursionError):
                self.flags["jsonld_malformed"] = True
                self.jsonld.append({"raw": text.strip(), "type": "", "malformed": True})

    def _gather_types(self, value):
        stack = [value]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                kind = x.get("@type")
                self.types += [k.encode("utf-8", "replace").decode() for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
                stack += reversed(list(x.values()))
            elif isinstance(x, list):
                stack += reversed(x)

    def handle_data(self, data):
        for tag, _, pieces in self.open:
            if not self.hidden or tag == "script":
                pieces.append(data)
        if self.hidden or any(tag == "title" for tag, _, _ in self.open):
            return
        if data.strip():
            self.in_body = True
        if self.in_body:
            self.pending.append(data)

    def row(self) -> dict:
        while self.open:  # elements never closed end with the document
            self._close(self.open[-1][0])
        self._flush()
        while self.tree:
            self._leave(-1)
        text = " ".join(self.text).strip()
        words = len(text.split())
        first = self.headings[0][0] if self.headings else 0
        out = {k: self.first.get(k, "") for k in ("title", "meta_description", "meta_robots", "canonical_raw", "rel_next", "rel_prev")}
        out |= self.seen | self.flags
        out |= {"canonical_resolved": self._resolved(out["canonical_raw"]) if out["canonical_raw"] else "", "hreflangs": self.hreflangs, "first_heading_level": first, "og": self.og, "twitter": self.twitter}
        out |= {f"h{k}": [t for level, t in self.headings if level == k and t] for k in range(1, 7)}
        out |= {"canonical_type": self._canonical_type(out["canonical_resolved"]), "main_content_word_count": self.main_words if self.has_main else self.other_words, "bounded_text": "".join(self.bounds).strip(), "assets": self.assets, "images": self.images, "jsonld": self.jsonld}
        out |= {"jsonld_types": self.types, "structured": validate(self.blocks), "links": self.links, "text": text, "word_count": words, "insecure_forms": self.forms, "h1_alt_only": self.alt_only, "invalid_in_head": self.in_head}
        out |= {"content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), "js_suspect": self.flags["has_spa_root"] or (words < 50 and self.seen["script_count"] >= 5)}
        return out


def parse_html(html: str | None, url: str | None) -> dict:
    """Fields of SCHEMA but for url_id. A null document is an empty one."""
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    return page.row() | {"url": url, "n_bytes": len((html or "").encode("utf-8", "replace"))}


def extract(pages: DataFrame) -> DataFrame:
    """Rows of SCHEMA from page_id, url and html: one for each document.

    A table in fewer splits than there are cores is dealt out first, as parsing costs far more than moving it.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    pages = pages.select("page_id", "url", "html")
    shape = to_arrow_schema(pages.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256).to_pydict()
                rows = []
                for i, u, h in zip(part["page_id"], part["url"], part["html"], strict=True):
                    row = parse_html(h, u)
                    row["url_id"] = i
                    rows.append(row)
                columns = [pa.array([tuple(x.items()) if pa.types.is_map(f.type) else x for x in (row[f.name] for row in rows)], f.type) for f in shape]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    if pages.rdd.getNumPartitions() < cores:
        pages = pages.repartition(cores)
    return pages.mapInArrow(run, SCHEMA)
