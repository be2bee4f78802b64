"""Structured data: which properties a JSON-LD object of a known type lacks."""

from __future__ import annotations

import json
from collections.abc import Iterator

# Of each type, the properties that rich results require and those that are recommended.
_ARTICLE = ("headline", "author", "datePublished", "image")
REQUIRED = {
    "Article": _ARTICLE,
    "BlogPosting": _ARTICLE,
    "NewsArticle": _ARTICLE,
    "Product": ("name",),
    "LocalBusiness": ("name", "address"),
    "BreadcrumbList": ("itemListElement",),
    "FAQPage": ("mainEntity",),
    "HowTo": ("name", "step"),
    "Event": ("name", "startDate", "location"),
    "Recipe": ("name", "image"),
    "Review": ("itemReviewed", "author", "reviewRating"),
    "SoftwareApplication": ("name", "offers"),
    "VideoObject": ("name", "thumbnailUrl", "uploadDate"),
    "Offer": ("price", "priceCurrency"),
    "AggregateRating": ("ratingValue",),
    "ItemList": ("itemListElement",),
}
RECOMMENDED = {
    "Article": ("dateModified", "publisher", "mainEntityOfPage"),
    "BlogPosting": ("dateModified", "publisher", "mainEntityOfPage"),
    "NewsArticle": ("dateModified", "publisher"),
    "Product": ("image", "description", "offers", "brand", "sku", "review", "aggregateRating"),
    "LocalBusiness": ("telephone", "openingHours", "geo", "image", "url", "priceRange"),
    "BreadcrumbList": (),
    "FAQPage": (),
    "HowTo": ("description", "image", "totalTime"),
    "Event": ("description", "endDate", "image", "offers", "organizer", "performer"),
    "Recipe": ("author", "description", "recipeIngredient", "recipeInstructions", "prepTime", "cookTime", "totalTime", "nutrition"),
    "Review": ("datePublished", "reviewBody"),
    "SoftwareApplication": ("operatingSystem", "applicationCategory", "aggregateRating", "review"),
    "VideoObject": ("description", "contentUrl", "duration", "embedUrl"),
    "Offer": ("availability", "url", "seller", "validFrom"),
    "AggregateRating": ("reviewCount", "ratingCount", "bestRating", "worstRating"),
    "ItemList": ("name", "numberOfItems"),
    "Organization": ("name", "url", "logo", "description", "sameAs", "contactPoint"),
    "Person": ("name", "url", "image", "jobTitle", "sameAs"),
    "WebSite": ("name", "url", "description", "publisher", "potentialAction"),
    "WebPage": ("name", "description", "url", "breadcrumb"),
    "Service": ("name", "description", "provider", "serviceType", "areaServed"),
    "ContactPage": ("name", "description", "url"),
    "AboutPage": ("name", "description", "url"),
    "CollectionPage": ("name", "description", "url", "mainEntity"),
    "ImageObject": ("contentUrl", "name", "description", "caption"),
}
# How deep objects are followed, and how many results a page gives.
DEEPEST, MOST_RESULTS = 5, 50


def _typed(value) -> Iterator[dict]:
    """Objects with a type that a property holds, alone or in a list."""
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict) and "@type" in x:
            yield x


def _objects(value: dict, depth: int = 0) -> Iterator[tuple[dict, int]]:
    """An object's graph, itself, and the typed objects below it, each with its depth."""
    if depth > DEEPEST:
        return
    graph = value.get("@graph")
    for x in graph if isinstance(graph, list) else []:
        if isinstance(x, dict):
            yield from _objects(x, depth + 1)
    yield value, depth
    for name, x in value.items():
        if name != "@graph":
            for inner in _typed(x):
                yield from _objects(inner, depth + 1)


def _lacks(value: dict, names: tuple[str, ...]) -> list[str]:
    return sorted(n for n in names if value.get(n) is None or value.get(n) in ("", [], {}))


def validate(blocks: list[str]) -> list[dict]:
    """Results of a page's JSON-LD blocks: type, missing_required, missing_recommended, nested; blocks that are no JSON have none."""
    found: list[dict] = []
    for block in blocks:
        try:
            value = json.loads(block)
        except (ValueError, RecursionError):
            continue
        for top in value if isinstance(value, list) else [value]:
            for x, depth in _objects(top) if isinstance(top, dict) else ():
                kinds = x.get("@type")
                for kind in kinds if isinstance(kinds, list) else [kinds]:
                    if isinstance(kind, str) and kind in RECOMMENDED:
                        found.append({"type": kind, "missing_required": _lacks(x, REQUIRED.get(kind, ())), "missing_recommended": _lacks(x, RECOMMENDED[kind]), "nested": depth > 0})
                        if len(found) == MOST_RESULTS:
                            return found
    return found
