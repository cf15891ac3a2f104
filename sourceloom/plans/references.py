"""Queries of the reference check, with SQL for comparison."""

from __future__ import annotations

from sourceloom.operators.references import orphan_references, orphan_report
from sourceloom.session import table


def p1_found(spark, sf_dir):
    calls = table(spark, sf_dir, "api_calls").select("call_id", "project", "method", "path", "scanned_at")
    return orphan_references(calls, table(spark, sf_dir, "routes")).select("call_id").distinct()


def p1_report(spark, sf_dir):
    return orphan_report(table(spark, sf_dir, "api_calls"), table(spark, sf_dir, "routes"))


_ORPHANS_SQL = r"""
WITH c AS (
  SELECT DISTINCT call_id, project, method, path, scanned_at FROM api_calls
  WHERE path IS NOT NULL AND NOT (lower(path) LIKE 'http://%' OR lower(path) LIKE 'https://%')
), cs AS (
  SELECT *, upper(trim(coalesce(method, 'GET'))) AS m,
    list_transform(list_filter(string_split(regexp_replace(path, '[?#].*$', '', 's'), '/'), lambda s: s <> ''),
      lambda s: CASE WHEN regexp_matches(s, '^(:[^\s:]+|\$?\{.*\}|<.*>|\[.*\])$') THEN '/' ELSE s END) AS seg0,
    regexp_matches(string_split(regexp_replace(path, '[?#].*$', '', 's'), '/')[1], '^(:[^\s:]+|\$?\{.*\}|<.*>|\[.*\])$') AS server
  FROM c
), cc AS (
  SELECT *, CASE WHEN server THEN seg0[2:] ELSE seg0 END AS seg FROM cs
), r AS (
  SELECT DISTINCT project, upper(trim(method)) AS m, first_seen, removed_at,
    list_transform(list_filter(string_split(regexp_replace(path, '[?#].*$', '', 's'), '/'), lambda s: s <> ''),
      lambda s: CASE WHEN regexp_matches(s, '^(:[^\s:]+|\$?\{.*\}|<.*>|\[.*\])$') THEN '/' ELSE s END) AS seg
  FROM routes
), hit AS (
  SELECT DISTINCT cc.call_id FROM cc JOIN r ON cc.project = r.project AND len(cc.seg) = len(r.seg)
    AND (r.m = 'ALL' OR r.m = cc.m) AND r.first_seen <= cc.scanned_at AND (r.removed_at IS NULL OR r.removed_at > cc.scanned_at)
  WHERE len(list_filter(list_zip(cc.seg, r.seg), lambda z: NOT (z[2] = '/' OR z[1] = z[2]))) = 0
), orphan AS (
  SELECT * FROM cc WHERE call_id NOT IN (SELECT call_id FROM hit)
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

ORACLES = {
    "p1_found": _ORPHANS_SQL + "SELECT DISTINCT call_id FROM orphan",
    "p1_report": _ORPHANS_SQL
    + """SELECT 'api_calls' AS referring_table, a.period, a.n_references, coalesce(b.n_orphans, 0) AS n_orphans,
  coalesce(b.n_orphan_keys, 0) AS n_orphan_keys
FROM (SELECT date_trunc('month', scanned_at)::TIMESTAMP AS period, count(*) AS n_references FROM cc GROUP BY 1) a
LEFT JOIN (SELECT date_trunc('month', scanned_at)::TIMESTAMP AS period, count(*) AS n_orphans,
  count(DISTINCT (project, method, path)) AS n_orphan_keys FROM orphan GROUP BY 1) b ON a.period IS NOT DISTINCT FROM b.period""",
}
