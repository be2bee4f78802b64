"""DuckDB SQL of the events' details and of purges down the tables, written apart from their DataFrame form."""

from webloom.plans.oracles import VIEWS

_EVENTS = """ce AS (SELECT event_id, value, CASE event_type WHEN 'purchase' THEN 'psi' WHEN 'signup' THEN 'axe' WHEN 'error' THEN 'metric' WHEN 'view' THEN 'markdown' ELSE 'event' END AS kind, props,
  CASE event_type WHEN 'view' THEN event_id % 2 = 0 WHEN 'purchase' THEN true WHEN 'signup' THEN true WHEN 'error' THEN true ELSE event_id % 3 = 2 END AS readable,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""

_BODIES = {
    "event_split": "SELECT event_id, kind, readable, CASE WHEN readable THEN k END AS k FROM ce WHERE readable OR kind = 'event'",
    "src_psi": """SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS performance, 0.0::DOUBLE AS accessibility, CAST(event_id % 5 AS DOUBLE) AS best_practices, 0.0::DOUBLE AS seo,
      0.0::DOUBLE AS lcp, 0.0::DOUBLE AS fcp, 0.0::DOUBLE AS cls, 0.0::DOUBLE AS tbt, floor(value) AS si, 0.0::DOUBLE AS ttfb FROM ce WHERE kind = 'psi'""",
    "psi_audits": """SELECT event_id, 'speed-index' AS audit, 'Speed' AS title, CAST(event_id % 3 AS DOUBLE) AS score FROM ce WHERE kind = 'psi'
      UNION ALL SELECT event_id, 'scored', '', 1.0 FROM ce WHERE kind = 'psi' AND event_id % 2 = 1""",
    "src_axe": """SELECT event_id, ['rule-' || event_id % 4, 'image-alt'][i] AS rule, ['minor', ''][i] AS impact, CAST([2, 0][i] AS BIGINT) AS n_nodes FROM ce, range(1, 3) r(i) WHERE kind = 'axe' AND event_id % 9 <> 0""",
    "audit_summary": "SELECT count(*) AS total, sum(event_id % 7) / count(*) AS avg_performance, NULL::DOUBLE AS avg_accessibility, sum(event_id % 5) / count(*) AS avg_best_practices, NULL::DOUBLE AS avg_seo FROM ce WHERE kind = 'psi'",
    "json_arrays": """SELECT event_id, CASE WHEN kind = 'markdown' AND event_id % 2 = 1 THEN CAST(json(props) AS VARCHAR) END AS first, CASE WHEN kind = 'markdown' AND event_id % 2 = 1 THEN 1::BIGINT END AS n FROM ce""",
    "snk_purge_cascade": """SELECT 'jobs' AS table_name, count(DISTINCT url_id % 8) AS n FROM u WHERE url_id % 8 NOT IN (2, 5)
      UNION ALL SELECT 'urls', count(*) FROM u WHERE url_id % 8 NOT IN (2, 5) UNION ALL SELECT 'pages', count(*) FROM u WHERE status = 'fetched' AND url_id % 8 NOT IN (2, 5)
      UNION ALL SELECT 'assets', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.url_id = a.url_id AND u.url_id % 8 IN (2, 5))
      UNION ALL SELECT 'fetches', count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.url_id = f.url_id AND u.url_id % 8 IN (2, 5))
      UNION ALL SELECT 'hops', CAST(sum(hop_count) AS BIGINT) FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.url_id = f.url_id AND u.url_id % 8 IN (2, 5))""",
    "link_headers": """SELECT event_id, CAST([0, 0, 1][i] AS INT) AS nth, ['https://x.example/' || event_id, 'https://x.example/' || event_id, '/s'][i] AS uri, CAST([2, 2, 1][i] AS INT) AS n_params,
      ['next', 'prefetch', event_type][i] AS rel FROM events, range(1, 4) r(i)""",
    "robots_signals": """SELECT page_id AS url_id, CAST(i - 1 AS INT) AS nth, ['search', 'ai-train', 'k'][i] AS signal, ['yes', CASE WHEN page_id % 2 = 0 THEN 'no' ELSE 'yes' END, page_id || '=1'][i] AS value FROM pages, range(1, 4) r(i)""",
    "retry_after": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 * 1000 WHEN 3 THEN 0 ELSE (90000000 - epoch_us(ts) % 1000000) // 1000 END AS wait_ms,
      CASE event_id % 3 WHEN 0 THEN event_id * 86400000000 WHEN 1 THEN event_id % 50 * 3600000000 + 121500000 END AS span_us FROM events""",
}

ORACLES = {name: f"WITH {VIEWS}, {_EVENTS} {body}" for name, body in _BODIES.items()}
