"""DuckDB SQL of the views of response headers, written apart from their DataFrame form: presence by arithmetic instead of JSON."""

from webloom.plans.oracles import VIEWS

_BASE = r"""
b AS (SELECT fetch_seq, f.url_id, url, [(fetch_seq // CAST(pow(2, i) AS BIGINT)) % 2 = 1 AND fetch_seq % 11 < 9 FOR i IN range(8)] AS named, fetch_seq % 11 < 9 AS known,
  CASE WHEN fetch_seq % 3 = 0 THEN 'a, b' WHEN fetch_seq % 5 = 0 THEN ' ' ELSE 'v' END AS value FROM f JOIN u USING (url_id)),
r AS (SELECT *, CASE WHEN named[5] THEN CASE WHEN fetch_seq % 7 = 0 THEN 'no-referrer' ELSE value END ELSE '' END AS referrer_policy, 7 - len(list_filter(named[1:7], lambda x: x)) AS missing_count,
  len([1 FOR i IN range(1, 8) IF named[i] AND (trim(value) <> '' OR i = 5 AND fetch_seq % 7 = 0)]) AS n_present FROM b),
w AS (SELECT url, max(7 - n_present) AS missing FROM r GROUP BY url)
"""
_RULE = "SELECT fetch_seq, '{0}' AS issue_type, '{1}' AS severity FROM r WHERE known AND {2}"
_HAS = "named[{0}]"  # a blank value is one, for the rules
_RULES = [
    ("missing_hsts_header", "warning", f"starts_with(url, 'https://') AND NOT {_HAS.format(1)}"),
    ("missing_x_content_type_options", "info", f"NOT {_HAS.format(3)}"),
    ("missing_x_frame_options", "info", f"NOT {_HAS.format(4)}"),
    ("missing_content_security_policy", "info", f"NOT {_HAS.format(2)}"),
    ("missing_referrer_policy", "info", "referrer_policy <> 'no-referrer'"),
    ("robots_meta_header_mismatch", "warning", _HAS.format(8)),
]
_BODIES = {
    "security_view": "SELECT fetch_seq, url_id, CAST(n_present AS INT) AS n_present, CAST(missing_count AS INT) AS missing_count, CASE WHEN named[1] THEN value ELSE '' END AS hsts, referrer_policy FROM r",
    "security_summary": "SELECT count(*) AS rows, CAST(sum(7 - missing) AS BIGINT) AS headers_present, CAST(sum(missing) AS BIGINT) AS headers_missing, count(*) FILTER (missing > 0) AS pages_with_issues FROM w",
    "srt_security": "SELECT fetch_seq, CAST(missing_count AS INT) AS missing_count FROM r ORDER BY missing_count DESC, fetch_seq LIMIT 50",
    "header_rules": " UNION ALL ".join(_RULE.format(*x) for x in _RULES),
}
ORACLES = {name: f"WITH {VIEWS.strip()},{_BASE}{body}" for name, body in _BODIES.items()}
