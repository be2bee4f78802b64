"""DuckDB SQL of the view queries, written apart from their DataFrame form."""

from webloom.plans.oracles import _BODIES, VIEWS

_URL_RULES = _BODIES["url_rules"]

_VIEW_BODIES = {
    "flt_contains": "SELECT url_id, url FROM u WHERE contains(lower(url), 'example.org/')",
    "flt_status_family": "SELECT fetch_seq, url_id, status_code FROM f WHERE status_code // 100 = 4",
    "flt_issue_presence": f"SELECT url_id, depth FROM p WHERE url_id IN (SELECT url_id FROM ({_URL_RULES}))",
    "flt_robots": r"SELECT url_id, CASE WHEN regexp_matches(q, '^/.*\?page=') THEN true WHEN regexp_matches(q, '^/.*\.html$') THEN false WHEN starts_with(q, '/es/') THEN false WHEN regexp_matches(q, '^/.*\?') THEN false ELSE true END AS allowed FROM (SELECT url_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '') AS q FROM u)",
    "pg_cursor": "SELECT url_id, status, (SELECT count(*) FROM u WHERE url_id > 20) > 50 AS has_more FROM u WHERE url_id > 20 ORDER BY url_id LIMIT 50",
    "jn_edge_endpoints": "SELECT DISTINCT l.source_id, l.target_id, mode AS discovery_mode, a.url AS source_url, b.url AS target_url, last.status_code FROM l JOIN u a ON a.url_id = source_id LEFT JOIN u b ON b.url_id = target_id LEFT JOIN last ON last.url_id = target_id",
    "agg_topn": f"SELECT issue_type, count(*) AS n, min(url_id) AS example_id FROM ({_URL_RULES}) GROUP BY issue_type ORDER BY n DESC, issue_type LIMIT 10",
    "topk_outbound": "SELECT source_id, count(*) AS outbound FROM l GROUP BY source_id ORDER BY outbound DESC, source_id LIMIT 5",
    "agg_count_distinct_filter": "SELECT status_code, count(*) AS fetches, count(DISTINCT url_id) AS pages, count(DISTINCT url_id) FILTER (ttfb_ms > 1000) AS slow_pages FROM f GROUP BY status_code",
    "agg_min_max_dedup": "SELECT key, max(url) AS url, max(source) AS source, count(*) AS n FROM m GROUP BY key",
    "agg_worst_per_key": "SELECT url_id, fetch_seq, ttfb_ms FROM f WHERE ttfb_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY ttfb_ms DESC, fetch_seq) = 1",
    "win_first_seen": None,
    "win_trap_once": "SELECT status_code, fetch_seq, url_id FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY status_code ORDER BY fetch_seq) AS seen FROM (SELECT status_code, fetch_seq, url_id, row_number() OVER (PARTITION BY status_code, url_id ORDER BY fetch_seq) = 1 AS fresh FROM f)) WHERE fresh AND seen = 21",
    "set_difference": "SELECT DISTINCT u.url_id FROM m JOIN u USING (key) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target_id = u.url_id AND mode = 'static')",
    "snk_upsert_update": "SELECT url_id, status_code, max(fetch_seq) AS fetch_seq, arg_max(ttfb_ms, fetch_seq) AS ttfb_ms FROM f GROUP BY url_id, status_code",
}
_VIEW_BODIES["win_first_seen"] = f"SELECT k.url_id, via AS discovered_via, frontier_key FROM (SELECT min(url_id) AS url_id, frontier_key FROM ({_BODIES['url_frontier_key']}) GROUP BY frontier_key) k JOIN u USING (url_id)"

ORACLES = {name: f"WITH {VIEWS} {body}" for name, body in _VIEW_BODIES.items()}
