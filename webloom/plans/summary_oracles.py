"""DuckDB SQL of the crawl's summary and of robots rules, written apart from their DataFrame form."""

from webloom.plans.finding_oracles import ORACLES as FINDINGS
from webloom.plans.oracles import _BODIES, VIEWS

_REPORT = f"""i AS (SELECT * FROM ({FINDINGS["issue_table"]})),
ty AS (SELECT issue_type, count(*) AS n, min(url_id) AS least FROM i GROUP BY issue_type),
st AS (SELECT ttfb_ms, row_number() OVER (ORDER BY ttfb_ms) - 1 AS k, count(*) OVER () AS total FROM f WHERE ttfb_ms IS NOT NULL),
w AS (SELECT date_diff('microseconds', min(ts), max(ts)) / 1e6 AS s FROM events)
SELECT (SELECT count(*) FROM p) AS total_pages, (SELECT count(*) FROM u) AS total_urls, (SELECT count(*) FROM i) AS total_issues,
  (SELECT string_agg(issue_type || '=' || n, ',' ORDER BY issue_type) FROM ty) AS issues_by_type,
  (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM i GROUP BY severity)) AS issues_by_severity,
  (SELECT string_agg(state || '=' || n, ',' ORDER BY state) FROM (SELECT state, count(*) AS n FROM p GROUP BY state)) AS indexability_distribution,
  (SELECT string_agg(status_code || '=' || n, ',' ORDER BY status_code) FROM (SELECT status_code, count(*) AS n FROM f GROUP BY status_code)) AS status_code_distribution,
  (SELECT string_agg(depth || '=' || n, ',' ORDER BY depth) FROM (SELECT depth, count(*) AS n FROM p GROUP BY depth)) AS depth_distribution,
  (SELECT round(avg(ttfb_ms), 6) FROM f) AS avg_ttfb, (SELECT CAST(ttfb_ms AS DOUBLE) FROM st WHERE k = total // 2) AS median_ttfb, (SELECT CAST(ttfb_ms AS DOUBLE) FROM st WHERE k = least(CAST(floor(total * 0.95) AS BIGINT), total - 1)) AS p95_ttfb,
  (SELECT round(avg(word_count), 6) FROM p) AS avg_word_count, (SELECT count(*) FROM pages WHERE contains(html, 'application/ld+json')) AS pages_with_structured_data,
  (SELECT count(DISTINCT url_id) FROM i WHERE url_id IN (SELECT url_id FROM p)) AS pages_with_issues, (SELECT count(*) FROM u WHERE key IN (SELECT key FROM m)) AS pages_in_sitemap,
  (SELECT count(*) FROM u WHERE url_id NOT IN (SELECT target_id FROM l)) AS orphan_page_count, (SELECT CAST(sum(member_count) AS BIGINT) FROM ({_BODIES["cluster_duplicate"]})) AS duplicate_content_count,
  (SELECT count(*) FROM p WHERE word_count < 200) AS thin_content_count, (SELECT round(s, 6) FROM w) AS crawl_duration, (SELECT round((SELECT count(*) FROM p) / s, 6) FROM w) AS pages_per_second,
  (SELECT string_agg(issue_type || ' ' || n || ' ' || coalesce((SELECT url FROM u WHERE url_id = least), ''), ',' ORDER BY n DESC, issue_type) FROM (SELECT * FROM ty ORDER BY n DESC, issue_type LIMIT 10)) AS top_issues"""
_PATHS = r"""q AS (SELECT url_id, host, url_id % 4 AS who, ['Mozilla/5.0 (compatible; Googlebot/2.1)', 'Googlebot-News', 'half', 'SomeBot'][url_id % 4 + 1] AS user_agent,
  regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '') AS path FROM u)"""
_BY_AGENT = r"""SELECT url_id, user_agent, CASE who WHEN 0 THEN regexp_matches(path, '\?page=') OR starts_with(path, '/en/') WHEN 1 THEN true WHEN 2 THEN path = '/de' OR NOT starts_with(path, '/de')
  ELSE NOT (starts_with(path, '/es/') OR position('.html' IN path) > 1 AND position('.html' IN path) = length(path) - 4) END AS allowed FROM q"""
_GROUPS = """SELECT DISTINCT host, user_agent, ['googlebot', 'googlebot-news', 'half', '*'][who + 1] AS agent, [3, 0, 2, 2][who + 1] AS n_rules, [7, 0, 0, 2][who + 1] AS crawl_delay FROM q"""
ORACLES = {"crawl_report": f"WITH {VIEWS}, {_REPORT}", "robots_by_agent": f"WITH {VIEWS}, {_PATHS} {_BY_AGENT}", "robots_groups": f"WITH {VIEWS}, {_PATHS} {_GROUPS}"}
