"""DuckDB SQL of the clusters of spellings and of URL groups, written apart from their DataFrame form."""

from webloom.plans.oracles import VIEWS

_KEY = r"regexp_replace(regexp_replace(regexp_replace({}, '#.*$', ''), '^(https?://)www\.', '\1'), '^(https?://[^/?]+/[^?]*[^/?])/+($|\?)', '\1\2')"
_SPELLED = rf"""
fl AS (SELECT url_id, arg_max(final_id, fetch_seq) AS final_id, arg_max(status_code, fetch_seq) AS status_code FROM f GROUP BY url_id),
s0 AS (SELECT u.url_id AS page_id, u.url AS page_url, fu.url AS final_url, fl.status_code, CASE u.url_id % 3 WHEN 1 THEN nu.url WHEN 2 THEN regexp_replace(u.url, '[?#].*$', '') || '/' END AS canonical_url,
  CASE WHEN u.url_id % 12 < 6 THEN 'same' ELSE p.content_hash END AS content_hash
  FROM u JOIN p USING (url_id) LEFT JOIN fl USING (url_id) LEFT JOIN u fu ON fu.url_id = fl.final_id LEFT JOIN u nu ON nu.url_id = u.url_id - u.url_id % 6),
s AS (SELECT *, {_KEY.format("coalesce(canonical_url, page_url)")} AS page_key, {_KEY.format("canonical_url")} AS own_key FROM s0),
v AS (SELECT page_key, kind, url, min(page_id) AS page_id, coalesce(arg_min(coalesce(status_code, 0), page_id), 0) AS status_code FROM (
  SELECT page_key, 'requested' AS kind, page_url AS url, page_id, status_code FROM s UNION ALL SELECT page_key, 'final', coalesce(final_url, page_url), page_id, status_code FROM s
  UNION ALL SELECT page_key, 'canonical', canonical_url, page_id, status_code FROM s WHERE canonical_url IS NOT NULL) GROUP BY page_key, kind, url),
c AS (SELECT page_key, arg_min(page_url, page_id) AS primary_url, arg_max(canonical_url, page_id) FILTER (canonical_url IS NOT NULL) AS canonical_url, count(DISTINCT page_url) AS page_count,
  CASE WHEN count(DISTINCT page_url) < 2 THEN 'redirect_consolidated' WHEN count(DISTINCT content_hash) > 1 THEN 'distinct_content' WHEN count(DISTINCT own_key) = 1 AND max(own_key) = page_key THEN 'canonicalized_duplicate' ELSE 'duplicate_content_variant' END AS cluster_type FROM s GROUP BY page_key),
k AS (SELECT c.*, (SELECT count(*) FROM v WHERE v.page_key = c.page_key) AS variant_count, CASE cluster_type WHEN 'canonicalized_duplicate' THEN 'info' WHEN 'duplicate_content_variant' THEN 'warning' END AS issue_severity FROM c)
"""
_GROUPS = r"""
g0 AS (SELECT url_id, path, split_part(path, '/', 2) AS seg, CASE WHEN regexp_matches(path, '^/[^/]*/[^/]*\.html$') THEN 'files' WHEN regexp_matches(path, '^/e[^/]/1[^/]*$') THEN 'ones' WHEN path = '/de' OR starts_with(path, '/de/') THEN 'german' END AS own FROM u),
g1 AS (SELECT seg FROM g0 WHERE seg NOT IN ('', 'de') GROUP BY seg HAVING count(*) >= 10)
SELECT url_id, coalesce(own, g1.seg) AS url_group, CASE WHEN own IS NOT NULL THEN 'user' WHEN g1.seg IS NOT NULL THEN 'auto' END AS group_source FROM g0 LEFT JOIN g1 USING (seg)"""
ORACLES = {
    "url_variant_clusters": f"WITH {VIEWS.strip()},{_SPELLED} SELECT page_key, primary_url, canonical_url, variant_count, page_count, cluster_type, issue_severity FROM k",
    "url_variant_spellings": f"WITH {VIEWS.strip()},{_SPELLED} SELECT page_key, kind, url, page_id, status_code FROM v",
    "report_clusters": f"WITH {VIEWS.strip()},{_SPELLED} SELECT page_key, variant_count, cluster_type FROM k ORDER BY issue_severity IS NULL, variant_count DESC, primary_url LIMIT 50",
    "url_group_pages": f"WITH {VIEWS.strip()},{_GROUPS}",
}
