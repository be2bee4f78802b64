"""DuckDB SQL of the site files, sinks and streams, written apart from their DataFrame form."""

from webloom.plans.finding_oracles import _FETCH_RULES
from webloom.plans.oracles import VIEWS

_STORE_BODIES = {
    "src_sitemap": "SELECT 'https://files.example/' || page_id || '.xml' AS sitemap_url, url AS loc, '0.5' AS priority FROM pages WHERE page_id % 10 <> 9",
    "src_llms": """SELECT url_id, CAST(nth AS INT) AS nth, [NULL, '', 'Page ' || url_id, 'More'][nth + 2] AS title, [NULL, 'about ' || url || '.', 'see <' || url || '> and http://x.example/a),', ''][nth + 2] AS content,
      CAST(len(list_distinct([regexp_replace(x, '[.,;:!?]+$', '') FOR x IN regexp_extract_all('about ' || url || '. <' || url || '> http://x.example/a),', 'https?://[^\\s<>")\\]]+')])) AS INT) AS n_urls FROM u, range(3) r(nth)""",
    "snk_update_else_insert": "SELECT asset_id, CASE WHEN asset_id % 5 <> 0 THEN url_id END AS url_id, CASE WHEN asset_id % 5 <> 0 THEN kind END AS kind, CASE WHEN asset_id % 2 = 0 THEN content_length * 2 ELSE content_length END AS content_length FROM a WHERE asset_id % 5 <> 0 OR asset_id % 2 = 0",
    "snk_update_case": "SELECT url_id, CASE WHEN url_id % 4 <> 3 THEN greatest(word_count, word_count + url_id % 5 - 2) ELSE word_count END AS word_count, CASE WHEN url_id % 4 <> 3 AND url_id % 5 > 2 THEN 'rendered ' || h1 ELSE h1 END AS h1, depth FROM p",
    "snk_invalidate": """SELECT url_id, 'thin_content' AS issue_type, 'page_local' AS scope FROM p WHERE word_count < 200 AND NOT (url_id % 2 = 0 AND word_count >= 100)
      UNION ALL SELECT url_id, 'missing_h1', 'page_local' FROM p WHERE h1 = '' AND url_id % 2 = 1 UNION ALL SELECT url_id, 'thin_content', 'global' FROM p WHERE word_count < 50""",
    "snk_replace_scope": f"SELECT fetch_seq, issue_type, severity FROM ({_FETCH_RULES}) WHERE severity <> 'error' OR fetch_seq % 2 = 0",
    "snk_purge": "SELECT event_id AS fetch_seq, user_id % n AS url_id FROM events, n WHERE ts >= TIMESTAMP '2024-01-10'",
    "snk_reap": "SELECT url_id, CASE status WHEN 'pending' THEN 'failed' ELSE status END AS status, CASE status WHEN 'pending' THEN '2024-01-31' END AS finished_at, CASE status WHEN 'pending' THEN 'orphaned' END AS error FROM u",
    "st_trap": "SELECT event_type || '/' || user_id % 5 AS path, CAST(31 AS BIGINT) AS n_queries FROM events GROUP BY ALL HAVING count(DISTINCT props) > 30",
    "st_slow_host": """SELECT host, seq, avg_ms FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS nth FROM (
      SELECT CAST(user_id % 40 AS VARCHAR) AS host, event_id AS seq, CAST(sum(CAST(floor(value * 10) AS BIGINT)) OVER w // 10 AS BIGINT) AS avg_ms, count(*) OVER w AS n
      FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id ROWS 9 PRECEDING)) WHERE n = 10 AND avg_ms > 500) WHERE nth = 1""",
    "st_frontier": "SELECT DISTINCT user_id, event_type FROM events",
    "st_count_cache": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "st_feed": "SELECT event_id, event_type FROM events WHERE event_id > 500",
}

ORACLES = {name: f"WITH {VIEWS} {body}" for name, body in _STORE_BODIES.items()}
