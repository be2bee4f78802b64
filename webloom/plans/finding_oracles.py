"""DuckDB SQL of the findings and of the browsing views, written apart from their DataFrame form."""

from webloom.plans.oracles import _BODIES, ORACLES as CRAWL, VIEWS

_FETCH_RULES = "SELECT fetch_seq, url_id, 'status_4xx' AS issue_type, 'error' AS severity FROM f WHERE status_code BETWEEN 400 AND 499 UNION ALL SELECT fetch_seq, url_id, 'status_5xx', 'error' FROM f WHERE status_code BETWEEN 500 AND 599 UNION ALL SELECT fetch_seq, url_id, 'redirect_chain', 'warning' FROM f WHERE hop_count > 1 UNION ALL SELECT fetch_seq, url_id, 'redirect_loop', 'error' FROM f WHERE loop UNION ALL SELECT fetch_seq, url_id, 'redirect_hops_exceeded', 'error' FROM f WHERE exceeded UNION ALL SELECT fetch_seq, url_id, 'very_slow_response', 'warning' FROM f WHERE ttfb_ms > 10000 UNION ALL SELECT fetch_seq, url_id, 'slow_response', 'info' FROM f WHERE ttfb_ms > 3000"
_RANK = "CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"
_GRAPH = "SELECT source_id, target_id, count(*) AS n_links, bool_or(mode = 'static') AS has_static FROM l GROUP BY ALL"
_BARE = "regexp_replace({}, '/+$', '')"
_VARIANTS = "SELECT key, count(*) AS variant_count, min(url) AS primary_url FROM (SELECT url, key FROM u UNION SELECT url, key FROM m) GROUP BY key HAVING count(*) > 1"
_DOMAIN = "array_to_string(string_split({0}, '.')[-2:], '.')"
_VIEW = f"""SELECT p.url_id, u.url, p.title, p.depth, p.word_count, (SELECT count(*) FROM l WHERE target_id = p.url_id) AS inbound, (SELECT count(*) FROM l WHERE source_id = p.url_id) AS outbound,
  (SELECT count(*) FROM ({_BODIES["url_rules"]}) r WHERE r.url_id = p.url_id) AS issues, last.status_code, u.key IN (SELECT key FROM m) AS in_sitemap FROM p JOIN u USING (url_id) LEFT JOIN last ON last.url_id = p.url_id"""

_FOUND = {
    "hreflang_not_reciprocal": "SELECT DISTINCT source_id AS url_id, target_id FROM h WHERE source_id <> target_id AND NOT EXISTS (SELECT 1 FROM h AS b WHERE b.source_id = h.target_id AND b.target_id = h.source_id)",
    "broken_hreflang_target": "SELECT DISTINCT h.source_id AS url_id, h.target_id, status_code FROM h JOIN last ON last.url_id = h.target_id WHERE status_code <> 200",
    "canonical_to_redirect": "SELECT p.url_id, p.canonical_id, status_code FROM p JOIN last ON last.url_id = p.canonical_id WHERE p.canonical_id <> p.url_id AND status_code IN (301, 302, 307, 308)",
    "broken_pagination_chain": "SELECT x.url_id, rel, target_id, status_code FROM (SELECT url_id, 'next' AS rel, next_id AS target_id FROM g UNION ALL SELECT url_id, 'prev', prev_id FROM g) x JOIN last ON last.url_id = x.target_id WHERE status_code <> 200",
    "pagination_canonical_mismatch": "SELECT url_id, canonical_id FROM p JOIN g USING (url_id) WHERE canonical_id <> url_id AND coalesce(next_id, prev_id) IS NOT NULL",
    "sitemap_non_200": f"SELECT u.url_id, m.url AS sitemap_url, status_code FROM m JOIN u ON {_BARE.format('m.url')} = {_BARE.format('u.url')} JOIN last USING (url_id) WHERE status_code <> 200",
    "sitemap_url_redirect_host_mismatch": f"SELECT u.url_id, u.host AS requested_host, v.host AS final_host FROM u JOIN (SELECT url_id, arg_max(final_id, fetch_seq) AS final_id FROM f GROUP BY url_id) x USING (url_id) JOIN u v ON v.url_id = x.final_id WHERE u.host <> v.host AND {_BARE.format('u.url')} IN (SELECT {_BARE.format('url')} FROM m)",
    "sitemap_url_external_host": f"SELECT key, min(url) AS url, min(host) AS host FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM m) WHERE host <> '' AND {_DOMAIN.format('host')} <> 'example.org' GROUP BY key",
    "image_over_100kb": "SELECT url_id, max(content_length) // 1024 AS size_kb FROM a WHERE kind = 'img_src' AND content_length > 102400 GROUP BY url_id",
    "sitemap_too_large": "SELECT source, count(*) AS entry_count FROM m GROUP BY source HAVING count(*) > 20",
    "fetch_rules": _FETCH_RULES,
    "prj_case": f"SELECT issue_type, {_RANK} AS severity_rank, count(*) AS n FROM ({_FETCH_RULES}) GROUP BY ALL",
    "topk_examples": f"SELECT * FROM ({_FETCH_RULES}) ORDER BY {_RANK}, issue_type, fetch_seq LIMIT 40",
    "cluster_url_variants": _VARIANTS,
    "srt_clusters": f"SELECT * FROM ({_VARIANTS}) ORDER BY variant_count DESC, primary_url LIMIT 50",
    "url_groups": "SELECT coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[1], '') AS url_group, count(*) AS n_urls, count(DISTINCT host) AS n_hosts FROM u GROUP BY 1",
    "sitemap_summary": "SELECT source, count(*) AS entries, count(DISTINCT key) AS keys, count(DISTINCT key) FILTER (key IN (SELECT key FROM u)) AS crawled_keys FROM m GROUP BY source",
    "link_graph": _GRAPH,
    "http_hosts": "SELECT host, count(*) FILTER (starts_with(url, 'http://')) AS http_urls, count(*) FILTER (starts_with(url, 'https://')) AS https_urls FROM u GROUP BY host",
    "page_bundle": f"SELECT p.url_id, title, depth, word_count, state AS indexability_state, last.status_code, c.inbound, c.linking_pages, c.outbound, (SELECT count(*) FROM ({_BODIES['url_rules']}) r WHERE r.url_id = p.url_id) AS url_issues FROM p LEFT JOIN last ON last.url_id = p.url_id JOIN ({_BODIES['link_counts']}) c ON c.url_id = p.url_id",
    "jobs_status": "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM u GROUP BY status",
    "srt_responses": "SELECT fetch_seq, status_code, ttfb_ms, (SELECT count(*) FROM f) AS total FROM f ORDER BY ttfb_ms DESC NULLS LAST, fetch_seq LIMIT 50 OFFSET 50",
    "srt_edges": f"SELECT *, (SELECT count(*) FROM ({_GRAPH})) AS total FROM ({_GRAPH}) ORDER BY target_id, source_id LIMIT 100",
    "srt_issues": f"SELECT fetch_seq, issue_type, (SELECT count(*) FROM ({_FETCH_RULES})) AS total FROM ({_FETCH_RULES}) ORDER BY {_RANK}, fetch_seq, issue_type LIMIT 50",
    "srt_assets": "SELECT asset_id, content_length, (SELECT count(*) FROM a) AS total FROM a ORDER BY content_length DESC, asset_id LIMIT 100",
    "srt_sitemap": "SELECT url, source FROM m ORDER BY url, source LIMIT 100",
    "srt_activity": "SELECT kind, id FROM (SELECT ts, 'fetch' AS kind, event_id AS id FROM events UNION ALL SELECT ts, 'phase', event_id FROM events WHERE event_type = 'error') ORDER BY ts DESC, kind, id DESC LIMIT 100",
    "flt_range": "SELECT url_id, depth FROM p WHERE depth >= 2 AND depth <= 4",
    "flt_default_2xx": "SELECT p.url_id FROM p JOIN last ON last.url_id = p.url_id WHERE status_code // 100 = 2",
    "flt_or_like": "SELECT url, source FROM m WHERE contains(lower(url), '/fr/') OR contains(CAST(source AS VARCHAR), '4')",
    "flt_sitemap_status": "SELECT url, source, CASE WHEN key IN (SELECT key FROM u WHERE status = 'fetched') THEN 'in_crawl' ELSE 'not_in_crawl' END AS state FROM m",
    "flt_analyzable": f"SELECT fetch_seq, f.url_id FROM f JOIN u ON u.url_id = f.final_id WHERE status_code // 100 = 2 AND {_DOMAIN.format('host')} = 'example.org'",
    "flt_scope": f"SELECT url_id, {_DOMAIN.format('host')} = 'example.net' AS by_domain, host = 'm.therou.example.com' AS by_host, host IN ('www.cheap-pills.example.com', 'spam-farm.example.org') AS by_list FROM u",
    "flt_activity": "SELECT fetch_seq, url_id FROM f WHERE fetch_seq > 900",
    "flt_force_render": "SELECT url_id, url FROM u WHERE regexp_matches(path, '^/e[^/]/1[^/]*$')",
    "prj_scalar_subquery": "SELECT url_id, (SELECT status_code FROM last WHERE last.url_id = p.url_id) AS status_code FROM p",
    "prj_exists_flag": "SELECT url_id, EXISTS (SELECT 1 FROM m WHERE m.key = u.key) AS in_sitemap FROM u",
    "jn_page_fetch": "SELECT p.url_id, depth, f.fetch_seq, status_code FROM p JOIN f ON f.url_id = p.url_id",
    "jn_or": f"SELECT source_id, target_id, n_links FROM ({_GRAPH}) WHERE source_id = 5 OR target_id = 5",
    "jn_fallback": "SELECT f.fetch_seq, final_id, coalesce(last.status_code, f.status_code) AS status FROM f LEFT JOIN last ON last.url_id = f.final_id WHERE f.status_code = 301",
    "jn_graph_both": "SELECT DISTINCT source_id, target_id FROM l JOIN u a ON a.url_id = source_id JOIN u b ON b.url_id = target_id WHERE a.status = 'fetched' AND b.status = 'fetched'",
    "jn_dim_lookup": "SELECT asset_id, coalesce(url, 'url:' || a.url_id) AS url FROM a LEFT JOIN u ON u.url_id = a.url_id AND status = 'fetched'",
    "jn_in_list": "SELECT fetch_seq, url_id, status_code FROM f WHERE url_id IN (1, 3, 5, 8)",
    "agg_group_expr": "SELECT coalesce(nullif(state, ''), 'unknown') AS state, count(*) AS n FROM p GROUP BY 1",
    "agg_sum": f"SELECT CAST(coalesce(sum(member_count), 0) AS BIGINT) AS members FROM ({_BODIES['cluster_duplicate']})",
    "agg_group_concat": "SELECT key, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources FROM m GROUP BY key",
    "agg_group_dedup": "SELECT DISTINCT l_partkey % n AS source_id, l_suppkey * 7 % n AS target_id, CASE l_returnflag WHEN 'R' THEN 'canonical' WHEN 'A' THEN 'hreflang' ELSE 'link' END AS relation_type FROM lineitem, n",
    "agg_min_depth": "SELECT target_id, min(depth + 1) AS depth FROM l JOIN p ON p.url_id = source_id GROUP BY target_id",
    "agg_counts_by_key": "SELECT host, status_code, count(*) AS n FROM f JOIN u USING (url_id) GROUP BY ALL",
    "agg_avg_multi": "SELECT round(avg(ttfb_ms) FILTER (status_code = 200), 6) AS ok_ms, round(avg(ttfb_ms) FILTER (status_code = 404), 6) AS missing_ms, round(avg(ttfb_ms) FILTER (status_code = 999), 6) AS none_ms FROM f",
    "agg_scalar_max2": f"SELECT url_id, greatest(inbound, outbound) AS most FROM ({_BODIES['link_counts']})",
    "agg_rate": "SELECT round(count(*) / ((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0), 9) AS rate FROM events",
    "win_consecutive": "SELECT url_id, len(list_filter(range(2, len(s) + 1), lambda i: s[i] <> '' AND s[i] = s[i - 1])) > 0 AS twice, len(list_filter(range(3, len(s) + 1), lambda i: s[i] <> '' AND s[i] = s[i - 1] AND s[i] = s[i - 2])) > 0 AS thrice FROM (SELECT url_id, string_split(path, '/') AS s FROM u)",
    "lim_preview": f"SELECT url, source FROM ({_BODIES['in_sitemap_not_crawled']}) ORDER BY url, source LIMIT 100",
    "nxt_job": "SELECT url_id, url FROM u WHERE status = 'pending' ORDER BY url_id LIMIT 1",
    # the tables' hosts are lower-cased without ports, and their paths hold no percent codes: what is left is fragments, www. and slashes
    "url_normalize": "SELECT url, n AS normalized, regexp_replace(regexp_replace(n, '^(https?://)www\\.', '\\1'), '^(https?://[^/?]+/[^?]*[^/?])/+(\\?|$)', '\\1\\2') AS identity FROM (SELECT url, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]*)(\\?|$)', '\\1/\\2') AS n FROM m)",
}
_WARNINGS = (
    "duplicate_title", "duplicate_description", "duplicate_content", "duplicate_h1", "duplicate_h2", "orphan_page", "hreflang_not_reciprocal", "canonical_chain", "canonical_to_redirect", "non_indexable_canonical", "unlinked_canonical", "broken_pagination_chain",
    "pagination_canonical_mismatch", "sitemap_non_200", "sitemap_url_redirect_host_mismatch", "sitemap_url_external_host", "in_sitemap_robots_blocked", "js_only_navigation", "image_over_100kb", "no_internal_outlinks", "non_indexable_in_sitemap",
)
_ISSUES = dict.fromkeys(_WARNINGS, "warning") | dict.fromkeys(("broken_hreflang_target", "canonical_to_non_200"), "error") | dict.fromkeys(("deep_page", "crawled_not_in_sitemap", "in_sitemap_not_crawled", "http_to_https_missing", "url_in_multiple_sitemaps"), "info")
_ID = {"js_only_navigation": "source_id", "sitemap_url_external_host": "NULL", "http_to_https_missing": "NULL", "url_in_multiple_sitemaps": "NULL"}
_DEEP = {"deep_page": f"SELECT url_id FROM ({CRAWL['page_depths']}) WHERE depth > 3"}
_FOUND["issue_table"] = " UNION ALL ".join(f"SELECT {_ID.get(k, 'url_id')} AS url_id, '{k}' AS issue_type, '{v}' AS severity, 'global' AS scope FROM ({(_BODIES | _FOUND | _DEEP)[k]})" for k, v in _ISSUES.items()) + f" UNION ALL SELECT url_id, issue_type, severity, 'page_local' FROM ({_FETCH_RULES})"
for _key, _column in {"url": "url", "title": "title", "status": "status_code", "sitemap": "in_sitemap", "depth": "depth", "words": "word_count", "issues": "issues", "inbound": "inbound", "outbound": "outbound"}.items():
    _way = "DESC NULLS LAST" if _key in ("words", "issues", "inbound", "outbound", "sitemap") else "ASC NULLS FIRST"
    _FOUND[f"srt_pages_{_key}"] = f"SELECT url_id, {_column} AS sorted_by, (SELECT count(*) FROM p) AS total FROM ({_VIEW}) ORDER BY {_column} {_way}, url_id LIMIT 50 OFFSET 20"

ORACLES = {name: f"WITH {VIEWS} {body}" for name, body in _FOUND.items()}
ORACLES["deep_page"] = f"SELECT url_id, depth, 3 AS threshold FROM ({CRAWL['page_depths']}) WHERE depth > 3"
