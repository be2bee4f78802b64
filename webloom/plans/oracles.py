"""DuckDB SQL of the crawl queries, written apart from their DataFrame form."""

VIEWS = r"""
n AS (SELECT max(page_id) + 1 AS n FROM pages),
u AS (SELECT page_id AS url_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host,
  CASE page_id % 10 WHEN 7 THEN 'robots_blocked' WHEN 8 THEN 'pending' ELSE 'fetched' END AS status,
  CASE page_id % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'sitemap' ELSE 'link' END AS via,
  regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '') AS key,
  regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
t AS (SELECT page_id AS url_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS h1 FROM pages),
p AS (SELECT url_id, url_id * 37 % 1009 * 100000 + url_id AS fetch_seq, title, h1, CASE WHEN title = '' THEN '' ELSE 'About ' || substr(title, 1, 8) END AS description, substr(h1, 1, 6) AS h2, sha256(text) AS content_hash, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS BIGINT) AS word_count,
  url_id % 6 AS depth, url_id - url_id % 3 AS canonical_id,
  CASE url_id % 7 WHEN 3 THEN 'noindex_meta' WHEN 5 THEN 'noindex_header' ELSE 'indexable' END AS state FROM t),
f AS (SELECT event_id AS fetch_seq, user_id % n AS url_id, CASE event_type WHEN 'purchase' THEN 404 WHEN 'error' THEN 500 WHEN 'signup' THEN 301 ELSE 200 END AS status_code,
  CAST(floor(value * 10) AS BIGINT) AS ttfb_ms, CASE WHEN event_type = 'signup' THEN (user_id % n * 3 + 1) % n ELSE user_id % n END AS final_id,
  CASE WHEN event_type = 'signup' THEN event_id % 4 ELSE 0 END AS hop_count, event_type = 'signup' AND event_id % 50 = 0 AS loop, event_type = 'signup' AND event_id % 60 = 0 AS exceeded FROM events, n),
h AS (SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN page_id + 1 ELSE page_id - 1 END AS target_id, CASE WHEN page_id % 3 = 0 THEN 'de' ELSE 'en' END AS lang FROM pages WHERE page_id % 3 = 0 OR page_id % 6 = 1),
g AS (SELECT page_id AS url_id, CASE WHEN page_id % 5 < 4 THEN page_id + 1 END AS next_id, CASE WHEN page_id % 5 > 0 THEN page_id - 1 END AS prev_id FROM pages),
a AS (SELECT p_partkey AS asset_id, p_partkey % n AS url_id, CASE WHEN p_size % 3 = 0 THEN 'css' ELSE 'img_src' END AS kind, CAST(p_size AS BIGINT) * 5000 + p_partkey % 1000 AS content_length FROM part, n),
l AS (SELECT l_partkey % n AS source_id, l_suppkey * 7 % n AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'browser' ELSE 'static' END AS mode
  FROM lineitem, n WHERE l_linestatus = 'F' AND l_returnflag NOT IN ('R', 'A')),
m AS (SELECT url, source, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '') AS key FROM (
  SELECT CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE url END AS url, page_id % 4 AS source FROM pages WHERE page_id % 3 <> 0
  UNION ALL SELECT regexp_replace(url, '^https?://', 'http://www.'), page_id % 4 + 1 FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 = 0)),
last AS (SELECT url_id, arg_max(status_code, fetch_seq) AS status_code, max(fetch_seq) AS fetch_seq FROM f GROUP BY url_id)
"""


def _copies(value: str) -> str:
    return f"SELECT url_id, {value} AS value, n AS group_size FROM (SELECT url_id, {value}, count(*) OVER (PARTITION BY {value}) AS n, row_number() OVER (PARTITION BY {value} ORDER BY fetch_seq) AS k FROM p WHERE {value} <> '') WHERE n > 1 AND k > 1"


_BODIES = {
    "duplicate_title": _copies("title"),
    "duplicate_h1": _copies("h1"),
    "duplicate_description": _copies("description"),
    "duplicate_h2": _copies("h2"),
    "duplicate_content": _copies("content_hash"),
    "thin_content": "SELECT url_id, word_count, 200 AS threshold FROM p WHERE word_count < 200",
    "title_length": "SELECT url_id, CASE WHEN length(title) = 0 THEN 'missing_title' WHEN length(title) > 60 THEN 'title_too_long' ELSE 'title_too_short' END AS issue_type, length(title) AS length FROM p WHERE length(title) < 30 OR length(title) > 60",
    "link_counts": "SELECT u.url_id, (SELECT count(*) FROM l WHERE l.target_id = u.url_id) AS inbound, (SELECT count(DISTINCT source_id) FROM l WHERE l.target_id = u.url_id) AS linking_pages, (SELECT count(*) FROM l WHERE l.source_id = u.url_id) AS outbound FROM u",
    "orphan_page": "SELECT url_id FROM u WHERE via <> 'seed' AND NOT EXISTS (SELECT 1 FROM l WHERE l.target_id = u.url_id)",
    "no_internal_outlinks": "SELECT url_id FROM u WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source_id = u.url_id)",
    "js_only_navigation": "SELECT source_id, target_id FROM l JOIN u s ON s.url_id = source_id JOIN u t ON t.url_id = target_id WHERE t.url NOT LIKE '%#%' AND regexp_replace(s.url, '#.*$', '') <> t.url GROUP BY source_id, target_id HAVING count(*) FILTER (mode = 'static') = 0",
    "win_latest": "SELECT * FROM last",
    "canonical_to_non_200": "SELECT p.url_id, p.canonical_id, status_code FROM p JOIN last ON last.url_id = p.canonical_id WHERE p.canonical_id <> p.url_id AND status_code <> 200",
    "canonical_chain": "SELECT a.url_id, a.url_id - a.url_id % 4 + 1 AS canonical_id, b.url_id - b.url_id % 4 AS next_id FROM u a JOIN u b ON b.url_id = a.url_id - a.url_id % 4 + 1 WHERE a.url_id <> b.url_id",
    "non_indexable_canonical": "SELECT a.url_id, a.canonical_id, b.state AS target_state FROM p a JOIN p b ON b.url_id = a.canonical_id WHERE a.url_id <> b.url_id AND b.state <> 'indexable'",
    "unlinked_canonical": "SELECT url_id, canonical_id FROM p WHERE canonical_id <> url_id AND canonical_id NOT IN (SELECT target_id FROM l)",
    "crawled_not_in_sitemap": "SELECT u.url_id FROM u JOIN p USING (url_id) WHERE state = 'indexable' AND key NOT IN (SELECT key FROM m)",
    "in_sitemap_not_crawled": "SELECT m.url, m.source, u.url_id FROM m LEFT JOIN u USING (key) WHERE u.url_id IS NULL OR u.status = 'pending'",
    "in_sitemap_robots_blocked": "SELECT m.url, m.source, u.url_id FROM m JOIN u USING (key) WHERE u.status = 'robots_blocked'",
    "non_indexable_in_sitemap": "SELECT m.url, u.url_id, state AS indexability_state FROM m JOIN u USING (key) JOIN p USING (url_id) WHERE state <> 'indexable'",
    "url_in_multiple_sitemaps": "SELECT min(url) AS url, count(DISTINCT source) AS sitemap_count FROM m GROUP BY key HAVING count(DISTINCT source) > 1",
    "http_to_https_missing": "SELECT DISTINCT host FROM u WHERE starts_with(url, 'http://') AND host NOT IN (SELECT a.host FROM f JOIN u a ON a.url_id = f.url_id JOIN u b ON b.url_id = f.final_id WHERE status_code = 301 AND starts_with(a.url, 'http://') AND starts_with(b.url, 'https://'))",
    "url_rules": "SELECT url_id, unnest(list_filter([CASE WHEN regexp_matches(d, '[A-Z]') THEN 'url_uppercase' END, CASE WHEN contains(d, '_') THEN 'url_underscores' END, CASE WHEN regexp_matches(url, '\\?[^#]') THEN 'url_has_parameters' END, CASE WHEN strlen(url) > 115 THEN 'url_too_long' END, CASE WHEN contains(d, '//') THEN 'url_multiple_slashes' END, CASE WHEN len(list_filter(range(2, len(s) + 1), lambda i: s[i] <> '' AND s[i] = s[i - 1])) > 0 THEN 'url_repetitive_path' END, CASE WHEN contains(url, '%20') OR contains(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', ''), '+') THEN 'url_contains_space' END], lambda x: x IS NOT NULL)) AS issue_type FROM (SELECT url_id, url, url_decode(path) AS d, string_split(path, '/') AS s FROM u)",
    "url_frontier_key": "SELECT url_id, CASE WHEN rest = '' THEN base ELSE base || '?' || rest END AS frontier_key FROM (SELECT url_id, regexp_replace(url, '[?#].*$', '') AS base, array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|gbraid|wbraid|msclkid|mc_cid|mc_eid)(=|$)')), '&') AS rest FROM u)",
    "agg_group_count": "SELECT status_code, count(*) AS n FROM f GROUP BY status_code",
    "agg_order_statistics": "SELECT max(ttfb_ms) FILTER (k = total // 2) AS median_ms, max(ttfb_ms) FILTER (k = least(CAST(floor(total * 0.95) AS BIGINT), total - 1)) AS p95_ms FROM (SELECT ttfb_ms, row_number() OVER (ORDER BY ttfb_ms) - 1 AS k, count(*) OVER () AS total FROM f WHERE ttfb_ms IS NOT NULL)",
    "win_ring10": "SELECT host, fetch_seq, CAST(floor(total / 10) AS BIGINT) AS mean_ms FROM (SELECT host, fetch_seq, CAST(sum(ttfb_ms) OVER w AS BIGINT) AS total, count(ttfb_ms) OVER w AS n FROM f JOIN u USING (url_id) WHERE ttfb_ms IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY fetch_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10 AND floor(total / 10) >= 5000",
    "slow_host": "SELECT host, fetch_seq, CAST(floor(total / 10) AS BIGINT) AS mean_ms FROM (SELECT host, fetch_seq, CAST(sum(ttfb_ms) OVER w AS BIGINT) AS total, count(ttfb_ms) OVER w AS n FROM f JOIN u USING (url_id) WHERE ttfb_ms IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY fetch_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10 AND floor(total / 10) >= 500",
    "cluster_canonical": "SELECT canonical_id, count(*) AS member_count FROM p GROUP BY canonical_id HAVING count(*) > 1",
    "cluster_duplicate": "SELECT cluster_type, value, count(*) AS member_count, min(url_id) AS first_id FROM (SELECT url_id, 'title' AS cluster_type, title AS value FROM p UNION ALL SELECT url_id, 'content', content_hash FROM p) WHERE value <> '' GROUP BY ALL HAVING count(*) > 1",
    "crawl_summary": "SELECT count(*) AS total_pages, count(*) FILTER (state = 'indexable') AS indexable, count(*) FILTER (word_count < 200) AS thin_pages, round(avg(word_count), 6) AS avg_words, max(depth) AS max_depth FROM p",
    "srt_pages": "SELECT url_id, depth FROM p ORDER BY depth DESC, url_id LIMIT 100 OFFSET 100",
}

ORACLES = {name: f"WITH {VIEWS} {body}" for name, body in _BODIES.items()}
#: Links walked level by level; a pair of page and depth is kept once, so the cyclic graph ends.
ORACLES["graph_bfs"] = f"WITH RECURSIVE {VIEWS}, e AS (SELECT DISTINCT source_id, target_id FROM l), b AS (SELECT CAST(0 AS BIGINT) AS url_id, CAST(0 AS BIGINT) AS depth UNION SELECT e.target_id, b.depth + 1 FROM b JOIN e ON e.source_id = b.url_id WHERE b.depth < 20) SELECT url_id, min(depth) AS depth FROM b GROUP BY url_id"
#: From all seeds; a page is walked on from once, at its first and least depth. Pages that are not reached keep their depth.
ORACLES["page_depths"] = f"WITH RECURSIVE {VIEWS}, e AS (SELECT DISTINCT source_id, target_id FROM l), b(url_id, depth) USING KEY (url_id) AS (SELECT url_id, CAST(0 AS BIGINT) FROM u WHERE via = 'seed' UNION SELECT e.target_id, min(b.depth) + 1 FROM b JOIN e ON e.source_id = b.url_id WHERE NOT EXISTS (SELECT 1 FROM recurring.b AS r WHERE r.url_id = e.target_id) GROUP BY e.target_id) SELECT p.url_id, coalesce(b.depth, p.depth) AS depth FROM p LEFT JOIN b USING (url_id)"
