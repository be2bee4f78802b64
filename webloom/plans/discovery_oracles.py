"""DuckDB SQL of what pages say about other URLs, written apart from its DataFrame form: the pages' markup is read by patterns."""

from webloom.plans.oracles import VIEWS

_LINKS = r"""
k AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS own, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>')) AS tag, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>')))) AS nth FROM pages),
e AS (SELECT page_id AS source_id, CAST(nth AS INT) AS nth, own, regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(replace(url_encode(regexp_extract(tag, 'href="([^"]*)"', 1)), '%2F', '/'), '%2C', ',') AS target_url,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, trim(regexp_extract(tag, '>([^<]*)<', 1)) AS anchor_text FROM k),
ei AS (SELECT *, host = 'example.org' OR host LIKE '%.example.org' AS is_internal FROM e WHERE target_url <> own),
known AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages),
bare AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_[^=]*=[^&]*$', '') AS url FROM pages)
"""
_BODY = r"regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', '', 'g')"
_WORDS = r"len(regexp_extract_all(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\S+'))"
_BODIES = {
    "page_edges": "SELECT source_id, nth, target_url, 'link' AS relation_type, anchor_text, is_internal, 0::INT AS n_flags, 'html' AS source_kind FROM ei",
    "page_url_rows": "SELECT target_url AS url, any_value(host) AS host, 'link' AS relations, min(source_id) AS first_source_id, bool_or(is_internal) AS is_internal FROM ei WHERE target_url NOT IN (SELECT url FROM known) GROUP BY target_url",
    "page_frontier": """SELECT target_url AS url, any_value(host) AS host, min(source_id % 6 + 1) AS depth, min(source_id) AS first_source_id FROM ei WHERE is_internal AND target_url NOT IN (SELECT url FROM bare) GROUP BY target_url""",
    "main_content": rf"""SELECT page_id AS url_id, CAST({_WORDS.format(_BODY)} AS INT) AS word_count, CAST({_WORDS.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS INT) AS main_content_word_count,
      CAST(len([1 FOR x IN string_split(regexp_replace(regexp_replace({_BODY}, '</?(h[1-6]|p|div|section|article|main|li|td|th|blockquote|figcaption|header|footer|nav|aside)(\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) IF trim(x) <> '']) AS INT) AS n_blocks,
      'absent' AS canonical_type, 'indexable' AS indexability_state FROM pages""",
    "url_registrable": """SELECT url_id, host, CASE i WHEN 0 THEN 'example.org' WHEN 1 THEN 'a.co.uk' WHEN 2 THEN 'b.co.uk' WHEN 3 THEN 'www.ck' WHEN 4 THEN 'city.kobe.jp' END AS registrable, i = 1 AS in_scope FROM (
      SELECT url_id, url_id % 7 AS i, CASE url_id % 7 WHEN 5 THEN 'shop.kobe.jp' WHEN 6 THEN 'co.uk' ELSE split_part(host, '.', 1) || '.' || ['example.org', 'a.co.uk', 'b.co.uk', 'www.ck', 'shop.city.kobe.jp'][url_id % 7 + 1] END AS host FROM u)""",
}
ORACLES = {name: f"WITH {VIEWS.strip()},{_LINKS}{body}" for name, body in _BODIES.items()}
