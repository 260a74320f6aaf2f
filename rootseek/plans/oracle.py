"""SQL checks of the registered queries, for DuckDB over the same tables.

Each check is written independently of the Spark code: plain window functions,
recursive CTEs and direct formulas. ``CTES`` are shared building blocks; a
check names the ones it starts from and pulls in what those need.
"""

from __future__ import annotations

import re

T0 = "TIMESTAMP '2024-01-25 00:00:00'"
T1 = "TIMESTAMP '2024-01-28 00:00:00'"

CTES = {
    # ---- telemetry -----------------------------------------------------------
    "metrics": f"""
        SELECT 'n' || (user_id % 12) AS node_id,
               CASE user_id % 12 WHEN 9 THEN 'database' WHEN 10 THEN 'queue' WHEN 11 THEN 'external_dep' ELSE 'service' END AS node_type,
               CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'view' THEN 'latency_p99' WHEN 'click' THEN 'request_rate'
                    WHEN 'purchase' THEN 'latency_p50' ELSE 'saturation' END AS metric_type,
               CASE WHEN ts >= {T0} AND event_type IN ('error', 'view') AND user_id % 12 IN (3, 4, 9, 11)
                    THEN value * 10 ELSE value END AS value,
               ts, event_id AS ord
        FROM events""",
    "lines": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM lineitem""",
    "spans0": """
        SELECT *, least(rn, 4) AS tier, (least(rn, 4) - 1) * 3 + l_suppkey % 3 AS nn FROM lines""",
    "spans1": """
        SELECT *, l_returnflag = 'R' AND nn <> 7 AS err, nn IN (6, 7, 8) AND l_linenumber % 2 = 0 AS calls_out FROM spans0""",
    "spans": """
        SELECT 't' || l_orderkey AS trace_id, 's' || l_orderkey || '-' || rn AS span_id,
               CASE WHEN rn > 1 THEN 's' || l_orderkey || '-' || (tier - 1) END AS parent_span_id,
               'n' || nn AS node_id, nn, 'op' || (l_partkey % 5) AS op,
               epoch_us(TIMESTAMP '2024-01-24 00:00:00') + ((l_orderkey * 7919) % 172800 + rn) * 1000000 AS start_us,
               round(l_extendedprice * 10, 0)::BIGINT AS dur_us,
               round(l_extendedprice * 10, 0) / 1000 AS duration_ms,
               err, calls_out,
               CASE WHEN nn = 9 OR nn = 11 OR calls_out THEN 'client' WHEN nn = 10 THEN 'producer' ELSE 'server' END AS kind,
               CASE WHEN nn = 1 THEN CASE WHEN err THEN 502 ELSE 200 END WHEN nn IN (9, 10) THEN NULL WHEN NOT err THEN 200
                    WHEN nn = 0 OR nn = 11 OR calls_out THEN 503 WHEN nn = 2 THEN 429 ELSE 500 END AS code,
               CASE WHEN nn = 11 OR calls_out THEN 'n11' END AS peer,
               CASE WHEN nn = 9 THEN 'SELECT * FROM t' || (l_partkey % 7) || ' WHERE id = ?' END AS stmt,
               CASE WHEN err AND nn = 5 THEN 'connectiontimeout' WHEN err AND nn = 3 THEN 'valueerror' ELSE '' END AS etype,
               CASE WHEN NOT err THEN NULL WHEN nn = 9 AND l_partkey % 5 = 0 THEN 'UniqueViolation'
                    WHEN l_partkey % 4 = 0 THEN 'NullPointerException' WHEN l_partkey % 4 = 1 THEN 'TimeoutError'
                    WHEN l_partkey % 4 = 2 THEN 'ConnectionPoolExhausted' ELSE 'ValueError' END AS exc_type,
               CASE WHEN err THEN 'order ' || l_orderkey END AS exc_msg,
               '1.' || (l_partkey % 3) AS version, 'env' || (l_orderkey % 3) AS env,
               l_partkey, l_suppkey, l_orderkey, rn, tier, l_orderkey::BIGINT * 1000 + rn AS ord
        FROM spans1""",
    "win": f"""
        SELECT * FROM spans WHERE start_us BETWEEN epoch_us({T0}) AND epoch_us({T1})""",
    "changes": f"""
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'deploy' WHEN '2-HIGH' THEN 'config_change' WHEN '4-NOT SPECIFIED' THEN 'config_change' ELSE 'feature_flag' END AS kind,
               'chg-' || o_orderkey AS event_id, 'n' || (o_custkey % 9) AS node_id,
               epoch_us({T0}) - ((o_orderkey * 7919) % 5400) * 1000000 AS ts_us,
               ((o_orderkey * 7919) % 5400) / 60.0 AS minutes,
               o_orderkey, o_custkey, o_orderstatus, o_orderkey AS ord
        FROM orders""",
    "commits": f"""
        SELECT 'commit-' || o_orderkey AS event_id, 'n' || (o_custkey % 9) AS node_id, o_orderkey,
               (o_orderkey * 104729) % 5400 AS secs_before
        FROM orders""",
    "config": """
        SELECT 'n' || (s_suppkey % 9) AS node_id, min(s_suppkey) % 4 <> 3 AS access FROM supplier GROUP BY 1""",
    # ---- series ------------------------------------------------------------
    "base": f"""
        SELECT node_id, metric_type, count(*) AS n, avg(value) AS mean, greatest(stddev_pop(value), 0.01) AS std,
               min(value) AS lo, max(value) AS hi
        FROM metrics WHERE ts < {T0} GROUP BY ALL""",
    "cur": f"""
        SELECT node_id, metric_type, avg(value) AS v, count(*) AS n, min(ord) AS first_ord
        FROM metrics WHERE ts >= {T0} AND ts < {T1} GROUP BY ALL""",
    "obs": f"""
        SELECT node_id, metric_type, avg(value) AS v FROM metrics WHERE ts >= {T0} AND ts <= {T1} GROUP BY ALL""",
    "dev": """
        SELECT node_id, metric_type, cur.v AS v, mean, std, least(20, greatest(-5, (cur.v - mean) / std)) AS z, first_ord
        FROM cur JOIN base USING (node_id, metric_type) WHERE base.n >= 3""",
    "anom": "SELECT * FROM dev WHERE z >= 3",
    "impact0": """
        SELECT o.node_id, max(CASE WHEN o.metric_type = 'error_rate' THEN o.v END) AS err,
               max(CASE WHEN o.metric_type = 'latency_p99' THEN o.v END) AS lat
        FROM obs o WHERE o.metric_type IN ('error_rate', 'latency_p99') GROUP BY 1""",
    "impact": """
        SELECT i.node_id, coalesce(err, 0.0) AS error_rate,
               CASE WHEN l.mean > 0 THEN coalesce(lat, l.mean) / l.mean ELSE 1.0 END AS lat_mult,
               coalesce(e.mean, 0.0) AS base_err, l.mean AS base_lat,
               (coalesce(err, 0.0) > coalesce(e.mean, 0.0) * 2 AND coalesce(err, 0.0) > 1)
                 OR (l.mean IS NOT NULL AND (CASE WHEN l.mean > 0 THEN coalesce(lat, l.mean) / l.mean ELSE 1.0 END) > 2) AS sick
        FROM impact0 i
        LEFT JOIN base e ON e.node_id = i.node_id AND e.metric_type = 'error_rate'
        LEFT JOIN base l ON l.node_id = i.node_id AND l.metric_type = 'latency_p99'""",
    # ---- graph -------------------------------------------------------------
    "mentions": """
        SELECT ord * 2 AS ord, node_id,
               CASE nn WHEN 9 THEN 'database' WHEN 10 THEN 'queue' WHEN 11 THEN 'external_dep' ELSE 'service' END AS node_type,
               CASE WHEN nn = 9 THEN 'PostgreSQL' END AS db_type, CASE WHEN nn = 10 THEN 'kafka' END AS queue_type,
               CASE WHEN nn = 11 THEN 'ext-' || (l_partkey % 5) END AS endpoint,
               CASE WHEN nn <= 8 THEN env END AS env, CASE WHEN nn = 10 THEN 'n10' END AS topics
        FROM spans
        UNION ALL
        SELECT ord * 2 + 1, 'n11', 'external_dep', NULL, NULL, NULL, NULL, NULL FROM spans WHERE calls_out""",
    "nodes": "SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ord) = 1",
    "edge_mentions": """
        SELECT p.node_id AS source_id, c.node_id AS target_id, CASE WHEN c.nn <= 8 THEN 'http' ELSE 'unknown' END AS protocol,
               c.ord * 2 + 1 AS ord
        FROM spans c JOIN spans p ON c.parent_span_id = p.span_id WHERE p.node_id <> c.node_id
        UNION ALL
        SELECT node_id, 'n11', 'http', ord * 2 FROM spans WHERE calls_out""",
    "edges": "SELECT * FROM edge_mentions QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY ord) = 1",
    # ---- edge weights --------------------------------------------------------
    "buckets": f"""
        SELECT node_id, metric_type, epoch(ts)::BIGINT // 86400 AS b, avg(value) AS v
        FROM metrics WHERE ts < {T0} AND metric_type IN ('error_rate', 'latency_p99') GROUP BY ALL""",
    "coupling": """
        SELECT source_id, target_id, x.metric_type, count(*) AS n,
               covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0) AS r
        FROM edges JOIN buckets x ON x.node_id = source_id
                   JOIN buckets y ON y.node_id = target_id AND y.metric_type = x.metric_type AND y.b = x.b
        GROUP BY ALL""",
    "weights0": """
        SELECT e.source_id, e.target_id, e.ord,
               coalesce((SELECT greatest(0, least(1, r)) FROM coupling c WHERE c.source_id = e.source_id AND c.target_id = e.target_id
                         AND c.metric_type = 'error_rate' AND c.n >= 3), 0.5) AS ec,
               coalesce((SELECT greatest(0, least(1, r)) FROM coupling c WHERE c.source_id = e.source_id AND c.target_id = e.target_id
                         AND c.metric_type = 'latency_p99' AND c.n >= 3), 0.5) AS lc,
               coalesce((SELECT mean FROM base b WHERE b.node_id = e.source_id AND b.metric_type = 'request_rate'), 10.0) AS vol
        FROM edges e""",
    "weights": "SELECT *, greatest(0, least(1, 0.4 * ec + 0.4 * lc + 0.2 * least(1, vol / 1000))) AS w FROM weights0",
    # ---- several incidents -----------------------------------------------------
    "starts": """
        SELECT * FROM (VALUES ('s1', TIMESTAMP '2024-01-05 00:00:00'), ('s2', TIMESTAMP '2024-01-09 07:30:00'), ('s3', TIMESTAMP '2024-01-10 00:00:00'),
                              ('s4', TIMESTAMP '2024-01-25 00:00:00'), ('s5', TIMESTAMP '2024-01-29 18:45:00')) v(incident_id, t)""",
    "past": "SELECT incident_id, t, m.* FROM starts JOIN metrics m ON m.ts < t",
    "base_starts": """
        SELECT incident_id, node_id, metric_type, count(*) AS n, avg(value) AS mean, greatest(stddev_pop(value), 0.01) AS std,
               min(value) AS lo, max(value) AS hi FROM past GROUP BY ALL""",
    "cur_starts": """
        SELECT incident_id, node_id, metric_type, avg(value) AS v FROM starts JOIN metrics m ON m.ts >= t AND m.ts < t + INTERVAL 3 DAY GROUP BY ALL""",
    "buckets_starts": """
        SELECT incident_id, node_id, metric_type, epoch(ts)::BIGINT // 86400 AS b, avg(value) AS v
        FROM past WHERE metric_type IN ('error_rate', 'latency_p99') GROUP BY ALL""",
    "coupling_starts": """
        SELECT x.incident_id, source_id, target_id, x.metric_type, count(*) AS n,
               covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0) AS r
        FROM edges JOIN buckets_starts x ON x.node_id = source_id
                   JOIN buckets_starts y ON y.incident_id = x.incident_id AND y.node_id = target_id AND y.metric_type = x.metric_type AND y.b = x.b
        GROUP BY ALL""",
    "graph_days": """
        SELECT incident_id, epoch_us(lo) AS lo, epoch_us(hi) AS hi FROM (
          VALUES ('s1', TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-24 23:59:59.999999'), ('s2', TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-25 23:59:59.999999'),
                 ('s3', TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-25 23:59:59.999999'), ('s4', TIMESTAMP '2024-01-26', TIMESTAMP '2024-01-26 23:59:59.999999')) v(incident_id, lo, hi)""",
    "own_nodes": """
        SELECT g.incident_id, m.* FROM mentions m JOIN spans s ON s.ord = m.ord // 2 JOIN graph_days g ON s.start_us BETWEEN g.lo AND g.hi
        QUALIFY row_number() OVER (PARTITION BY g.incident_id, m.node_id ORDER BY m.ord) = 1""",
    # ---- candidates ----------------------------------------------------------
    "changed": f"""
        SELECT DISTINCT node_id FROM changes WHERE ts_us BETWEEN epoch_us({T0}) - 3600000000 AND epoch_us({T0})
        UNION SELECT node_id FROM commits WHERE secs_before <= 3600""",
    "cands": """
        SELECT n.node_id, n.node_type, min(reason) AS reason, arg_min(pos, (reason, pos)) AS pos
        FROM (SELECT node_id, 0 AS reason, min(struct_pack(a := -z, b := first_ord)) AS pos FROM anom
              WHERE metric_type IN ('error_rate', 'latency_p99') GROUP BY node_id
              UNION ALL
              SELECT c.node_id, 1, struct_pack(a := 0.0::DOUBLE, b := n.ord) FROM changed c JOIN nodes n USING (node_id)
              WHERE n.node_type = 'service') u
        JOIN nodes n USING (node_id) GROUP BY n.node_id, n.node_type""",
    "sev": """
        SELECT n.node_id, CASE WHEN i.node_id IS NULL THEN 0.5
               WHEN greatest(least(1, error_rate / 100), greatest(0, least(1, (lat_mult - 1) / 5))) > 0
               THEN greatest(least(1, error_rate / 100), greatest(0, least(1, (lat_mult - 1) / 5))) ELSE 0.5 END AS s
        FROM nodes n LEFT JOIN impact i USING (node_id)""",
    "walks": """
        SELECT node_id AS cand, node_id, 0 AS hop, s::DOUBLE AS s, []::BIGINT[] AS path FROM sev
        UNION ALL
        SELECT cand, source_id, hop + 1, k.s * w, list_append(path, weights.ord)
        FROM walks k JOIN weights ON weights.target_id = k.node_id""",
    "forward": """
        SELECT * FROM walks QUALIFY row_number() OVER (PARTITION BY cand, node_id ORDER BY hop, path) = 1""",
    "fit": """
        SELECT n.node_id, 1 - avg(CASE WHEN f.cand IS NULL THEN 1.0 ELSE least(1,
                 0.7 * least(1, abs(f.s * 100 - i.error_rate) / greatest(1, i.error_rate))
                 + 0.3 * least(1, abs(1 + f.s * 5 - i.lat_mult) / greatest(1, i.lat_mult))) END) AS fit
        FROM nodes n JOIN impact i ON TRUE LEFT JOIN forward f ON f.cand = n.node_id AND f.node_id = i.node_id
        GROUP BY 1""",
    "sick": "SELECT node_id FROM impact WHERE sick",
    "roots": """
        SELECT node_id FROM sick WHERE node_id NOT IN
          (SELECT source_id FROM edges WHERE target_id IN (SELECT node_id FROM sick))""",
    "reached": """
        SELECT n.node_id AS cand, r.node_id FROM nodes n JOIN roots r ON r.node_id <> n.node_id
        UNION
        SELECT k.cand, e.source_id FROM reached k JOIN edges e ON e.target_id = k.node_id
        WHERE e.source_id IN (SELECT node_id FROM sick) AND e.source_id <> k.cand""",
    "cf": """
        SELECT n.node_id, CASE WHEN (SELECT count(*) FROM sick) = 0 THEN 0.0 ELSE
                 (SELECT count(*) FROM reached k WHERE k.cand = n.node_id) / (SELECT count(*) FROM sick) END AS residual
        FROM nodes n""",
    "scores": """
        SELECT node_id, fit, residual, 1 - residual AS cf, least(1, greatest(0, 0.6 * fit + 0.4 * (1 - residual))) AS cc
        FROM fit JOIN cf USING (node_id)""",
    "signals": f"""
        SELECT n.node_id, coalesce(has_err, FALSE) AS has_err, coalesce(h503, FALSE) AS h503, coalesce(h429, FALSE) AS h429,
               coalesce(h200, FALSE) AS h200, coalesce(tmo, FALSE) AS tmo,
               n.node_type = 'service' AND n.node_id IN (SELECT node_id FROM changed) AS chg,
               n.node_id IN (SELECT node_id FROM obs WHERE metric_type IN ('error_rate', 'latency_p99')) AS met
        FROM nodes n LEFT JOIN (
          SELECT node_id, bool_or(err) AS has_err, bool_or(code = 503) AS h503, bool_or(code = 429) AS h429,
                 bool_or(code = 200) AS h200, bool_or(etype LIKE '%timeout%' OR etype LIKE '%connection%') AS tmo
          FROM win GROUP BY 1) USING (node_id)""",
    "neighbours": """
        SELECT target_id AS suspect, source_id AS node_id, 'predecessor' AS direction, 0 AS d, ord FROM edges
        UNION ALL SELECT source_id, target_id, 'successor', 1, ord FROM edges""",
    "pairs": """
        SELECT p.*, s.* EXCLUDE (node_id),
               CASE WHEN s.h503 OR s.h429 OR s.tmo THEN 'error_code_pattern'
                    WHEN direction = 'successor' AND o.has_err AND s.h200 AND NOT s.has_err THEN 'silent_degradation'
                    WHEN s.chg AND s.has_err THEN 'change_event' WHEN NOT s.met AND s.has_err THEN 'missing_telemetry'
                    WHEN s.chg AND s.met THEN 'sub_threshold_metric' WHEN s.has_err THEN 'span_errors' END AS signal
        FROM neighbours p JOIN signals s USING (node_id) JOIN signals o ON o.node_id = p.suspect""",
    # ---- the three iterations --------------------------------------------------
    "rank1": """
        SELECT c.node_id, c.node_type, c.reason, cc, row_number() OVER (ORDER BY round(cc, 12) DESC, c.reason, c.pos) AS rk
        FROM cands c JOIN scores USING (node_id) QUALIFY rk <= 5""",
    "hints1": """
        SELECT p.*, r.rk FROM pairs p JOIN rank1 r ON r.node_id = p.suspect
        WHERE signal IS NOT NULL AND p.node_id NOT IN (SELECT node_id FROM rank1)""",
    "cands2": """
        SELECT node_id, min(reason) AS reason,
               arg_min(pos, (reason, pos)) AS pos
        FROM (SELECT node_id, reason, struct_pack(a := pos.a, b := pos.b, c := 0::BIGINT) AS pos FROM cands
              UNION ALL SELECT node_id, 2, struct_pack(a := rk::DOUBLE, b := d::BIGINT, c := ord) FROM hints1)
        WHERE node_id NOT IN (SELECT node_id FROM rank1) AND (SELECT count(*) FROM hints1) > 0 GROUP BY 1""",
    "rank2": """
        SELECT c.node_id, n.node_type, c.reason, cc, row_number() OVER (ORDER BY round(cc, 12) DESC, c.reason, c.pos) AS rk
        FROM cands2 c JOIN scores USING (node_id) JOIN nodes n USING (node_id) QUALIFY rk <= 5""",
    "known2": "SELECT node_id FROM rank1 UNION SELECT node_id FROM rank2",
    "hints2": """
        SELECT p.*, r.rk FROM pairs p JOIN rank2 r ON r.node_id = p.suspect
        WHERE signal IS NOT NULL AND p.node_id NOT IN (SELECT node_id FROM known2)""",
    "cands3": """
        SELECT node_id, min(reason) AS reason, arg_min(pos, (reason, pos)) AS pos
        FROM (SELECT node_id, reason, struct_pack(a := pos.a, b := pos.b, c := 0::BIGINT) AS pos FROM cands
              UNION ALL SELECT node_id, 2, struct_pack(a := rk::DOUBLE, b := d::BIGINT, c := ord) FROM hints2)
        WHERE node_id NOT IN (SELECT node_id FROM known2) AND (SELECT count(*) FROM hints2) > 0 GROUP BY 1""",
    "rank3": """
        SELECT c.node_id, n.node_type, c.reason, cc, row_number() OVER (ORDER BY round(cc, 12) DESC, c.reason, c.pos) AS rk
        FROM cands3 c JOIN scores USING (node_id) JOIN nodes n USING (node_id) QUALIFY rk <= 5""",
    "involved": """
        SELECT 1 AS it, node_id FROM cands
        UNION SELECT 2, node_id FROM cands2 UNION SELECT 2, node_id FROM rank1
        UNION SELECT 3, node_id FROM cands3 UNION SELECT 3, node_id FROM known2""",
    "loop": """
        SELECT r.*, NOT EXISTS (SELECT 1 FROM edges e JOIN involved v ON v.node_id = e.target_id AND v.it = r.it
                                WHERE e.source_id = r.node_id) AS origin
        FROM (SELECT *, 1 AS it FROM rank1 UNION ALL SELECT *, 2 FROM rank2 UNION ALL SELECT *, 3 FROM rank3) r""",
    # ---- evidence --------------------------------------------------------------
    "exc": "SELECT node_id, exc_type, count(*) AS n, min(ord) AS first FROM win WHERE err AND exc_type IS NOT NULL GROUP BY ALL",
    "ops": """
        SELECT node_id, op, count(*) AS total, count(*) FILTER (WHERE err) AS errors, min(ord) FILTER (WHERE err) AS first
        FROM win GROUP BY ALL HAVING errors > 0""",
    "worst": "SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY errors / total DESC, first) = 1",
    "deploys": """
        SELECT * FROM changes WHERE kind = 'deploy' AND minutes BETWEEN 0 AND 30 AND node_id IN (SELECT node_id FROM nodes)
        QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY minutes, ord) = 1""",
    "services": "SELECT node_id FROM nodes WHERE node_type = 'service'",
    "settings": """
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY kind = 'config_change', ord) AS place
        FROM changes WHERE kind <> 'deploy' AND minutes BETWEEN 0 AND 15 AND node_id IN (SELECT node_id FROM services)""",
    "frames": """
        SELECT node_id, span_id, ord,
               CASE l_partkey % 3 WHEN 1 THEN 'mod' || (l_partkey % 6) || '.py' ELSE '/srv/app/mod' || (l_partkey % 6) || '.py' END AS file_path,
               CASE l_partkey % 3 WHEN 2 THEN '<anonymous>' ELSE 'fn' || (l_suppkey % 8) END AS function_name,
               (l_partkey % 40 + 1)::INTEGER AS line, 'mod' || (l_partkey % 6) || '.py' AS base
        FROM win WHERE err AND nn <= 8""",
    # ---- code ------------------------------------------------------------------
    "dlines0": """
        SELECT l_orderkey, rn, CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE ' ' END AS kind,
               'x' || l_partkey || ' = ' || l_suppkey AS text
        FROM lines""",
    "dlines": """
        SELECT *, (l_orderkey % 30 + CASE WHEN rn > 2 THEN 11 ELSE 3 END + count(*) FILTER (WHERE kind <> '-') OVER w)::INTEGER AS new_line,
               (l_orderkey % 30 + CASE WHEN rn > 2 THEN 8 ELSE 1 END + count(*) FILTER (WHERE kind <> '+') OVER w)::INTEGER AS old_at
        FROM dlines0 WINDOW w AS (PARTITION BY l_orderkey, rn > 2 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "syms": """
        SELECT f, f * 5 + 1 AS old_from, f * 5 + 5 AS old_to, f * 5 + 2 AS new_from, f * 5 + 6 AS new_to,
               f <> 6 AS in_old, f <> 1 AS in_new
        FROM (SELECT unnest(range(8)) AS f)""",
    "hit": """
        SELECT DISTINCT l_orderkey, f FROM dlines JOIN syms ON in_new AND new_line BETWEEN new_from AND new_to WHERE kind <> ' '""",
    "gone": """
        SELECT DISTINCT l_orderkey, f FROM dlines JOIN syms ON in_old AND old_at BETWEEN old_from AND old_to WHERE kind = '-'
        EXCEPT SELECT l_orderkey, f FROM hit""",
    "funcs": """
        SELECT l_orderkey, f, CASE WHEN in_old THEN 'modified' ELSE 'added' END AS change_type, new_from AS start_line, new_to AS end_line,
               in_old AS has_old, TRUE AS has_new FROM hit JOIN syms USING (f)
        UNION ALL
        SELECT l_orderkey, f, 'deleted', old_from, old_to, TRUE, FALSE FROM gone JOIN syms USING (f)""",
    "linked": """
        SELECT c.node_id, c.event_id, c.o_orderkey FROM commits c JOIN config USING (node_id)
        WHERE access AND secs_before <= 1800 AND node_id IN (SELECT node_id FROM services)""",
    "lfuncs": """
        SELECT k.node_id, k.event_id, 'mod' || (k.o_orderkey % 6) || '.py' AS base, 'fn' || f AS function_name, start_line,
               k.o_orderkey, change_type = 'deleted' AS del, f
        FROM linked k JOIN funcs ON funcs.l_orderkey = k.o_orderkey""",
    "matches": """
        SELECT fr.node_id, fr.span_id, fr.line, g.event_id, g.function_name, g.base,
               CASE WHEN abs(fr.line - g.start_line) <= 3 THEN 0 WHEN fr.function_name = g.function_name THEN 1 ELSE 2 END AS rank,
               fr.ord, g.o_orderkey, g.del, g.f
        FROM frames fr JOIN lfuncs g ON g.node_id = fr.node_id AND g.base = fr.base
        QUALIFY row_number() OVER (PARTITION BY fr.node_id ORDER BY rank, fr.ord, g.o_orderkey, g.del, g.f) = 1""",
    "ev_code": """
        SELECT node_id, 'code' AS engine, 'deploy_in_window' AS signal, CASE WHEN minutes <= 15 THEN 'strong' ELSE 'moderate' END AS strength,
               1 AS section, 0::BIGINT AS item, minutes::DOUBLE AS measure FROM deploys JOIN services USING (node_id)
        UNION ALL SELECT DISTINCT node_id, 'code', 'exception_in_spans', 'moderate', 2, 0, NULL FROM exc JOIN services USING (node_id)
        UNION ALL SELECT node_id, 'code', 'stacktrace_match', CASE rank WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END, 4, 0, line FROM matches
        UNION ALL SELECT node_id, 'code', 'degraded_operation', 'weak', 6, 0, errors / total FROM worst JOIN services USING (node_id)
        UNION ALL SELECT node_id, 'code', 'no_deploy_in_window', 'weak', 7, 0, NULL FROM services WHERE node_id NOT IN (SELECT node_id FROM deploys)""",
    "ev_config": """
        SELECT node_id, 'config' AS engine, CASE kind WHEN 'feature_flag' THEN 'feature_flag_change' ELSE 'config_change' END AS signal,
               CASE WHEN minutes <= 5 THEN 'strong' ELSE 'moderate' END AS strength,
               CASE kind WHEN 'feature_flag' THEN 1 ELSE 2 END AS section, ord AS item, minutes::DOUBLE AS measure FROM settings
        UNION ALL SELECT node_id, 'config', 'post_change_errors', 'moderate', 4, 0, errors / total FROM worst
                  WHERE node_id IN (SELECT node_id FROM settings)
        UNION ALL SELECT node_id, 'config', 'simultaneous_change', 'moderate', 5, 0, NULL FROM deploys
                  WHERE node_id IN (SELECT node_id FROM settings)""",
    "dbz": """
        SELECT s.node_id, errors / spans * 100 AS pct, b.mean, b.std, (errors / spans * 100 - b.mean) / b.std AS z
        FROM (SELECT node_id, count(*) AS spans, count(*) FILTER (WHERE err) AS errors FROM win WHERE nn = 9 GROUP BY 1) s
        JOIN base b ON b.node_id = s.node_id AND b.metric_type = 'error_rate'""",
    "ev_db": """
        SELECT DISTINCT node_id, 'database' AS engine, 'db_integrity_error' AS signal, 'strong' AS strength, 1 AS section, 0::BIGINT AS item,
               NULL::DOUBLE AS measure FROM exc WHERE node_id = 'n9' AND exc_type = 'UniqueViolation'
        UNION ALL SELECT node_id, 'database', 'error_rate_spike', CASE WHEN z >= 5 THEN 'strong' WHEN z >= 3 THEN 'moderate' ELSE 'weak' END, 2, 0, z FROM dbz
        UNION ALL SELECT DISTINCT node_id, 'database', 'db_statement', 'weak', 3, 0, NULL FROM win WHERE nn = 9 AND err""",
    "calls": "SELECT peer AS node_id, code, count(*) AS calls, min(ord) AS first FROM win WHERE peer IS NOT NULL GROUP BY ALL",
    "scope": """
        SELECT count(DISTINCT node_id) AS affected, (SELECT count(*) FROM edges WHERE target_id = 'n11') AS callers
        FROM win WHERE peer = 'n11' AND err""",
    "ev_dep": """
        SELECT 'n11' AS node_id, 'dependency' AS engine, 'http_error_pattern' AS signal,
               CASE WHEN calls / (SELECT sum(calls) FROM calls) >= 0.5 THEN 'strong' ELSE 'moderate' END AS strength,
               1 AS section, 0::BIGINT AS item, (calls / (SELECT sum(calls) FROM calls))::DOUBLE AS measure
        FROM calls WHERE code BETWEEN 500 AND 599
        UNION ALL SELECT 'n11', 'dependency', 'all_callers_affected', CASE WHEN affected = callers THEN 'strong' ELSE 'moderate' END, 2, 0, affected / callers
        FROM scope""",
    "evidence": "SELECT * FROM ev_code UNION ALL SELECT * FROM ev_config UNION ALL SELECT * FROM ev_db UNION ALL SELECT * FROM ev_dep",
    "arb0": """
        SELECT s.node_id, count(*) FILTER (WHERE engine = 'code' AND strength = 'strong') AS cs,
               count(*) FILTER (WHERE engine = 'code' AND strength = 'moderate') AS cm,
               count(*) FILTER (WHERE engine = 'config' AND strength = 'strong') AS gs,
               count(*) FILTER (WHERE engine = 'config' AND strength = 'moderate') AS gm
        FROM services s LEFT JOIN evidence e USING (node_id) GROUP BY 1""",
    "arb": """
        SELECT *, CASE WHEN gs > cs OR (gs = cs AND gm > cm) THEN 'config' ELSE 'code' END AS winner, cs > 0 AND gs > 0 AS both FROM arb0""",
    "findings": """
        SELECT a.node_id, winner, "both",
               CASE WHEN NOT "both" AND winner = 'config' AND EXISTS (SELECT 1 FROM settings t WHERE t.node_id = a.node_id)
                    THEN 'configuration' ELSE 'application_code' END AS domain,
               CASE WHEN "both" OR winner = 'code' THEN
                      CASE WHEN EXISTS (SELECT 1 FROM deploys d WHERE d.node_id = a.node_id) THEN 'code_regression'
                           WHEN EXISTS (SELECT 1 FROM exc x WHERE x.node_id = a.node_id) THEN 'runtime_error' ELSE 'application_error' END
                    WHEN EXISTS (SELECT 1 FROM settings t WHERE t.node_id = a.node_id AND kind = 'feature_flag') THEN 'feature_flag_regression'
                    WHEN EXISTS (SELECT 1 FROM settings t WHERE t.node_id = a.node_id) THEN 'config_regression'
                    ELSE 'application_error' END AS failure_type,
               CASE WHEN (CASE winner WHEN 'code' THEN cs ELSE gs END) >= 1 THEN 0.20
                    WHEN (CASE winner WHEN 'code' THEN cm ELSE gm END) >= 2 THEN 0.10 ELSE 0.0 END AS priority
        FROM arb a
        UNION ALL SELECT 'n9', NULL, NULL, 'database', 'db_error', 0.15 FROM nodes WHERE node_id = 'n9'
        UNION ALL SELECT 'n10', NULL, NULL, 'queue', 'queue_error', 0.0 FROM nodes WHERE node_id = 'n10'
        UNION ALL SELECT 'n11', NULL, NULL, 'dependency', 'upstream_outage', CASE WHEN affected = callers THEN 0.15 ELSE 0.05 END FROM scope""",
    "scored": """
        SELECT l.node_id, l.it, l.rk, l.cc, f.domain, f.failure_type, coalesce(cents, 0) AS cents, coalesce(items, 0) AS items,
               coalesce(strong, 0) AS strong, row_number() OVER (ORDER BY coalesce(cents, 0) DESC, it, rk) AS score_rank
        FROM loop l JOIN findings f USING (node_id) LEFT JOIN (
          SELECT node_id, least(95, sum(CASE strength WHEN 'strong' THEN 35 WHEN 'moderate' THEN 15 ELSE 5 END))::INTEGER AS cents,
                 count(*) AS items, count(*) FILTER (WHERE strength = 'strong') AS strong
          FROM evidence GROUP BY 1) USING (node_id)""",
    "multi": """
        SELECT coalesce(list_sort(list(DISTINCT domain) FILTER (WHERE strong > 0)), []) AS domains
        FROM scored WHERE it = (SELECT max(it) FROM scored)""",
    "leads": """
        SELECT * FROM scored WHERE cents >= 65 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score_rank) = 1""",
    "verdicts": """
        SELECT CASE WHEN (SELECT len(domains) FROM multi) >= 2 AND (SELECT count(*) FROM leads) >= 2 THEN 'multi_factor'
                    WHEN (SELECT max(cents) FROM scored) >= 70 THEN 'root_cause_found'
                    WHEN (SELECT max(cents) FROM scored) > 0 THEN 'top_hypotheses' ELSE 'no_root_cause_found' END AS verdict""",
    "causes": """
        SELECT s.* FROM scored s JOIN verdicts v ON TRUE WHERE
          (verdict = 'multi_factor' AND score_rank IN (SELECT score_rank FROM leads ORDER BY score_rank LIMIT 2))
          OR (verdict = 'root_cause_found' AND score_rank = 1) OR (verdict = 'top_hypotheses' AND score_rank <= 3)""",
}

def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", sql))
    return [name for name in CTES if name in words]


def _with(sql: str) -> str:
    """Prefix a query with the building blocks it needs, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for used in _uses(CTES[name]):
            if used != name:
                add(used)
        order.append(name)

    for name in _uses(sql):
        add(name)
    if not order:
        return sql
    blocks = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    return f"WITH RECURSIVE {blocks}\n{sql.strip()}"


PREDICTED = "round(s * 100, 6) AS predicted_error_rate, round(1 + s * 5, 6) AS predicted_latency_multiplier"
SHOW = "node_id, signal, strength, section, item, round(measure, 6) AS measure"
REASON = "CASE reason WHEN 0 THEN 'metric_anomaly' WHEN 1 THEN 'change_event' ELSE 'investigation_hint' END"
RAW_CHANGE = """kind, event_id, node_id AS service_id, ts_us,
    CASE WHEN kind = 'deploy' THEN 'v' || (o_orderkey % 10) END AS version,
    CASE WHEN kind = 'config_change' THEN 'update' END AS change_type,
    CASE WHEN kind <> 'deploy' THEN 'key' || (o_orderkey % 20) END AS key,
    CASE WHEN kind <> 'deploy' THEN o_orderstatus END AS old_value,
    CASE WHEN kind <> 'deploy' THEN 'x' || (o_orderkey % 3) END AS new_value,
    'dev' || (o_custkey % 50) AS author,
    CASE WHEN kind = 'deploy' AND o_orderkey % 2 = 0 THEN 'touches fn' || (o_orderkey % 8) END AS diff_summary,
    CASE WHEN kind = 'deploy' THEN node_id END AS scope, 'team' || (o_custkey % 4) AS team, ord"""
PUSH_TIME = """epoch_us(o_orderdate) - CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200000000 ELSE -19800000000 END"""
BAD_SPAN = "ord % 101 = 0 OR ord % 103 = 0 OR ord % 107 = 0"

CHECKS = {
    "anomalous_nodes": """SELECT node_id, metric_type, round(v, 6) AS current_value, round(mean, 6) AS baseline_mean,
        round(std, 6) AS baseline_std, round(z, 6) AS z_score FROM anom""",
    "baseline_stats": "SELECT node_id, metric_type, n AS sample_count, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min_value, hi AS max_value FROM base",
    "baseline_ema": f"""
        SELECT node_id, metric_type, round(sum(value * CASE WHEN r = n THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, r - 1) END), 6) AS ema, max(n) AS sample_count
        FROM (SELECT *, row_number() OVER (PARTITION BY node_id, metric_type ORDER BY ts DESC, ord DESC) AS r,
                     count(*) OVER (PARTITION BY node_id, metric_type) AS n FROM metrics WHERE ts < {T0}) GROUP BY ALL""",
    "baseline_ema_starts": """
        SELECT incident_id, node_id, metric_type, round(sum(value * CASE WHEN r = n THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, r - 1) END), 6) AS ema, max(n) AS sample_count
        FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, node_id, metric_type ORDER BY ts DESC, ord DESC) AS r,
                     count(*) OVER (PARTITION BY incident_id, node_id, metric_type) AS n FROM past) GROUP BY ALL""",
    "baseline_stats_starts": """
        SELECT incident_id, node_id, metric_type, n AS sample_count, round(mean, 9) AS mean, round(std, 9) AS std, lo AS min_value, hi AS max_value FROM base_starts""",
    "deviations_starts": """
        SELECT incident_id, node_id, metric_type, round(v, 6) AS current_value, round(least(20, greatest(-5, (v - mean) / std)), 6) AS z_score,
               (v - mean) / std >= 3 AS is_anomalous
        FROM cur_starts JOIN base_starts USING (incident_id, node_id, metric_type) WHERE n >= 3""",
    "edge_weights_starts": """
        SELECT incident_id, source_id, target_id, round(ec, 6) AS error_coupling, round(lc, 6) AS latency_coupling, round(vol, 9) AS call_volume,
               round(greatest(0, least(1, 0.4 * ec + 0.4 * lc + 0.2 * least(1, vol / 1000))), 6) AS weight
        FROM (
          SELECT i.incident_id, e.source_id, e.target_id,
                 coalesce((SELECT greatest(0, least(1, r)) FROM coupling_starts c WHERE c.incident_id = i.incident_id AND c.source_id = e.source_id
                           AND c.target_id = e.target_id AND c.metric_type = 'error_rate' AND c.n >= 3), 0.5) AS ec,
                 coalesce((SELECT greatest(0, least(1, r)) FROM coupling_starts c WHERE c.incident_id = i.incident_id AND c.source_id = e.source_id
                           AND c.target_id = e.target_id AND c.metric_type = 'latency_p99' AND c.n >= 3), 0.5) AS lc,
                 coalesce((SELECT mean FROM base_starts b WHERE b.incident_id = i.incident_id AND b.node_id = e.source_id AND b.metric_type = 'request_rate'), 10.0) AS vol
          FROM edges e JOIN (SELECT DISTINCT incident_id, node_id FROM base_starts) i ON i.node_id = e.source_id)""",
    "current_mean": "SELECT node_id, metric_type, round(v, 6) AS current_value, n AS cur_n FROM cur",
    "deviations": "SELECT node_id, metric_type, round(z, 6) AS z_score, z >= 3 AS is_anomalous FROM dev",
    "baseline_summary": "SELECT node_id, " + ", ".join(
        f"round(max(mean) FILTER (WHERE metric_type = '{m}'), 6) AS {m}"
        for m in ("error_rate", "latency_p50", "latency_p99", "request_rate", "saturation")
    ) + " FROM base GROUP BY 1",
    "default_start": "SELECT epoch_us(max(ts)) - 300000000 AS start_us FROM metrics",
    "observed_impact": """SELECT node_id, round(error_rate, 6) AS error_rate, round(lat_mult, 6) AS latency_multiplier,
        round(base_err, 6) AS baseline_error_rate, round(base_lat, 6) AS baseline_latency, sick AS is_anomalous FROM impact""",
    "edge_weights": """SELECT source_id, target_id, round(ec, 6) AS error_coupling, round(lc, 6) AS latency_coupling,
        round(vol, 6) AS call_volume, round(w, 6) AS weight FROM weights""",
    "fetch_metrics": """SELECT ord, node_id, metric_type, value FROM metrics
        WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND node_id = 'n3'""",
    "ingest_spans": f"""SELECT trace_id, span_id, parent_span_id, node_id AS service_id, op AS operation_name, kind, start_us, duration_ms,
        (CASE WHEN err THEN 2 ELSE 0 END)::INTEGER AS otel_status_code, code AS http_status_code, peer, version, exc_type AS exception_type
        FROM spans WHERE NOT ({BAD_SPAN})""",
    "ingest_metrics": """SELECT node_id, node_type, metric_type, round(value, 6) AS value, epoch_us(ts) AS ts_us, 60::INTEGER AS window_seconds, 'u' AS unit, ord
        FROM metrics WHERE ord % 50 NOT IN (1, 3, 4, 5, 6, 7)""",
    "ingest_metrics_strict": """SELECT node_id, metric_type, count(*) AS n, round(sum(value), 4) AS total
        FROM metrics WHERE ord % 50 NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9) GROUP BY ALL""",
    "ingest_commits": """
        SELECT 'commit-' || o_orderkey AS event_id, 'n' || (o_custkey % 9) AS service_id, md5(o_orderkey::VARCHAR) AS commit_sha, 'dev' || (o_custkey % 50) AS author,
               CASE WHEN o_orderkey % 2 = 0 THEN 'chg-' || o_orderkey END AS deploy_event_id,
               epoch_us(o_orderdate::TIMESTAMP) - CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 7200000000 END AS ts_us, NULL::VARCHAR AS reason
        FROM orders WHERE o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 29 = 0 THEN 'missing commit_sha' ELSE 'bad timestamp' END
        FROM orders WHERE o_orderkey % 29 = 0 OR o_orderkey % 31 = 0""",
    "scan_files": f"""
        SELECT 'traces' AS source, count(*) AS good, count(*) AS orders FROM spans WHERE NOT ({BAD_SPAN})
        UNION ALL SELECT 'metrics', count(*), count(*) FROM metrics WHERE ord % 50 NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9)
        UNION ALL SELECT 'changes', count(*), count(*) FROM changes WHERE ord % 40 NOT IN (1, 2, 3) AND NOT (ord % 40 = 4 AND kind = 'deploy')""",
    "ingest_changes": f"SELECT {RAW_CHANGE} FROM changes WHERE ord % 40 NOT IN (1, 2, 3) AND NOT (ord % 40 = 4 AND kind = 'deploy')",
    "ingest_rejects": """
        SELECT 'spans' AS source, CASE WHEN ord % 101 = 0 THEN 'empty spanId' WHEN ord % 107 = 0 THEN 'unparseable timestamp' ELSE 'end before start' END AS reason,
               count(*) AS n FROM spans WHERE ord % 101 = 0 OR ord % 107 = 0 OR ord % 103 = 0 GROUP BY ALL
        UNION ALL
        SELECT 'metrics', CASE ord % 50 WHEN 1 THEN 'non-numeric value' WHEN 3 THEN 'bad timestamp' WHEN 4 THEN 'unknown node_type'
               WHEN 5 THEN 'window_seconds must be positive' WHEN 6 THEN 'negative value' ELSE 'missing unit' END, count(*)
        FROM metrics WHERE ord % 50 IN (1, 3, 4, 5, 6, 7) GROUP BY ALL
        UNION ALL
        SELECT 'changes', CASE ord % 40 WHEN 1 THEN 'missing service_id' WHEN 2 THEN 'unknown event_type' WHEN 3 THEN 'bad timestamp'
               ELSE 'deploy_scope must be a list' END, count(*)
        FROM changes WHERE ord % 40 IN (1, 2, 3) OR (ord % 40 = 4 AND kind = 'deploy') GROUP BY ALL""",
    "ingest_push_github": f"""
        SELECT 'github-' || substr(sha, 1, 12) AS event_id, 'n' || (o_custkey % 9) AS service_id, sha AS commit_sha,
               'https://h/' || o_custkey AS repo_url, 'main' AS branch, 'u' || o_custkey || '@example.org' AS author,
               'm' || o_orderkey AS commit_message, {PUSH_TIME} AS ts_us, o_orderkey AS ord
        FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN md5(o_orderkey::VARCHAR) ELSE sha1(o_orderkey::VARCHAR) END AS sha FROM orders)
        WHERE o_orderkey % 31 <> 0""",
    "ingest_push_gitlab": f"""
        SELECT 'gitlab-' || substr(sha1(o_orderkey::VARCHAR), 1, 12) AS event_id, 'n' || (o_custkey % 9) AS service_id,
               sha1(o_orderkey::VARCHAR) AS commit_sha, 'https://l/' || o_custkey AS repo_url, 'rel/1' AS branch,
               'u' || o_custkey || '@example.org' AS author, 'm' || o_orderkey AS commit_message, {PUSH_TIME} AS ts_us, o_orderkey AS ord
        FROM orders WHERE o_orderkey % 37 <> 0""",
    "span_flags": """SELECT node_id AS service_id, version AS service_version, env AS environment, count(*) FILTER (WHERE err) AS is_error,
        count(*) FILTER (WHERE code >= 500) AS is_server_error, count(*) FILTER (WHERE code BETWEEN 400 AND 499) AS is_client_error,
        count(*) FILTER (WHERE parent_span_id IS NULL) AS is_root, count(*) AS n FROM spans GROUP BY ALL""",
    "fetch_spans": """SELECT span_id, start_us FROM spans WHERE node_id = 'n4'
        AND start_us >= epoch_us(TIMESTAMP '2024-01-24 06:00:00') AND start_us < epoch_us(TIMESTAMP '2024-01-24 18:00:00')""",
    "graph_nodes": """SELECT n.node_id, node_type, db_type, queue_type, endpoint, env, topics,
        CASE WHEN node_type = 'service' AND access IS NOT NULL THEN access ELSE FALSE END AS code_access_enabled,
        CASE WHEN node_type = 'service' AND access IS NOT NULL THEN 'https://git.example.org/' || n.node_id END AS repo_url, ord
        FROM nodes n LEFT JOIN config USING (node_id)""",
    "graph_edges": "SELECT source_id, target_id, 'calls' AS edge_type, protocol, ord FROM edges",
    "change_attach": """SELECT node_id AS service_id, kind, count(*) AS n, max(ts_us) AS last_us FROM changes
        WHERE node_id IN (SELECT node_id FROM services) GROUP BY ALL""",
    "known_topology": """
        SELECT 'n' || (n_nationkey * 2) AS id, 'queue' AS kind, NULL::VARCHAR AS target FROM nation
        UNION ALL SELECT node_id, node_type, NULL FROM nodes WHERE node_id NOT IN (SELECT 'n' || (n_nationkey * 2) FROM nation)
        UNION ALL SELECT 'n' || r_regionkey, 'depends_on', 'n' || (r_regionkey + 3) FROM region
        UNION ALL SELECT source_id, 'calls', target_id FROM edges
        WHERE NOT EXISTS (SELECT 1 FROM region WHERE 'n' || r_regionkey = source_id AND 'n' || (r_regionkey + 3) = target_id)""",
    "incident_graph_nodes": """
        SELECT incident_id, node_id, node_type, db_type, queue_type, endpoint, env, ord FROM own_nodes""",
    "incident_graph_edges": """
        SELECT incident_id, source_id, target_id, 'calls' AS edge_type, protocol, ord FROM (
          SELECT g.incident_id, e.* FROM edge_mentions e JOIN spans s ON s.ord = e.ord // 2 JOIN graph_days g ON s.start_us BETWEEN g.lo AND g.hi)
        WHERE (incident_id, source_id) IN (SELECT (incident_id, node_id) FROM own_nodes) AND (incident_id, target_id) IN (SELECT (incident_id, node_id) FROM own_nodes)
        QUALIFY row_number() OVER (PARTITION BY incident_id, source_id, target_id ORDER BY ord) = 1""",
    "incident_db_systems": """
        SELECT DISTINCT g.incident_id, node_id, 'postgresql' AS db_system FROM spans s JOIN graph_days g ON s.start_us BETWEEN g.lo AND g.hi WHERE nn = 9""",
    "dag_check_incidents": """
        WITH RECURSIVE ring AS (SELECT n_regionkey AS r, n_nationkey AS a, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey),
                      CASE WHEN n_regionkey IN (0, 2) THEN min(n_nationkey) OVER (PARTITION BY n_regionkey) END) AS b FROM nation),
        reach AS (SELECT r, a, b FROM ring WHERE b IS NOT NULL UNION SELECT k.r, k.a, c.b FROM reach k JOIN ring c ON c.r = k.r AND c.a = k.b WHERE c.b IS NOT NULL)
        SELECT 'r' || r AS incident_id, count(*) FILTER (WHERE (r, a) IN (SELECT (k.r, k.a) FROM reach k WHERE k.a = k.b)) AS cyclic_edges,
               count(*) FILTER (WHERE (r, a) IN (SELECT (k.r, k.a) FROM reach k WHERE k.a = k.b)) = 0 AS is_dag
        FROM ring WHERE b IS NOT NULL GROUP BY r""",
    "dag_check": """SELECT count(*) AS cyclic_edges, count(*) = 0 AS is_dag FROM walks WHERE hop > 0 AND cand = node_id""",
    "db_systems": "SELECT DISTINCT node_id, 'postgresql' AS db_system FROM spans WHERE nn = 9",
    "causal_events": """SELECT row_number() OVER (ORDER BY tier, start_us, ord) AS position, span_id, node_id, (tier - 1)::INTEGER AS depth, err AS is_error,
        coalesce(code >= 500, FALSE) AS is_server_error FROM spans""",
    "causal_depth": "SELECT span_id, (tier - 1)::INTEGER AS depth FROM spans",
    "node_timeline": """
        SELECT node_id, count(*) AS total_span_count, count(*) FILTER (WHERE err) AS error_span_count,
               round(count(*) FILTER (WHERE err) / count(*), 6) AS error_rate, round(avg(tier - 1), 6) AS causal_position,
               (min(tier - 1) FILTER (WHERE err))::INTEGER AS first_error_depth,
               arg_min(span_id, (tier, start_us, ord)) FILTER (WHERE err) AS first_error_span_id,
               coalesce(count(*) FILTER (WHERE err) / count(*) >= 0.1 AND min(tier - 1) FILTER (WHERE err) <= 2, FALSE) AS is_likely_origin
        FROM spans GROUP BY 1""",
    "origin_candidates": """
        SELECT node_id, (min(tier - 1) FILTER (WHERE err))::INTEGER AS first_error_depth, count(*) FILTER (WHERE err) AS error_span_count,
               coalesce(count(*) FILTER (WHERE err) / count(*) >= 0.1 AND min(tier - 1) FILTER (WHERE err) <= 2, FALSE) AS is_likely_origin
        FROM spans WHERE node_id IN (SELECT node_id FROM anom) GROUP BY 1 HAVING count(*) FILTER (WHERE err) > 0""",
    "trace_totals": "SELECT count(DISTINCT trace_id) AS trace_count, count(*) AS span_count FROM spans",
    "failure_severity": "SELECT node_id, round(s, 6) AS severity FROM sev WHERE node_id IN (SELECT node_id FROM cands)",
    "forward_impact": f"""SELECT cand AS candidate_id, node_id, hop::INTEGER AS hop, {PREDICTED},
        round(CASE WHEN hop = 0 THEN 1.0 ELSE greatest(0.1, 1 - hop * 0.15) END, 6)::DOUBLE AS confidence
        FROM forward WHERE cand IN (SELECT node_id FROM cands)""",
    "simple_paths": """
        , trails AS (
          SELECT node_id AS cand, node_id, [node_id] AS path FROM cands
          UNION ALL
          SELECT cand, source_id, list_append(path, source_id) FROM trails t JOIN edges e ON e.target_id = t.node_id
          WHERE NOT list_contains(path, source_id) AND len(path) <= 5)
        SELECT cand AS candidate_id, node_id, array_to_string(path, '>') AS path FROM trails WHERE len(path) > 1""",
    "counterfactual": """SELECT node_id, round(residual, 6) AS residual_explanation,
        round(CASE WHEN (SELECT count(*) FROM sick) > 0 THEN 1 - residual ELSE 0 END, 6) AS counterfactual,
        (SELECT count(*) FROM sick) > 0 AND residual < 0.25 AS is_necessary FROM cf WHERE node_id IN (SELECT node_id FROM cands)""",
    "fit_score": "SELECT node_id, round(fit, 6) AS fit FROM fit WHERE node_id IN (SELECT node_id FROM cands)",
    "rank_candidates": f"""SELECT node_id, node_type, {REASON} AS inclusion_reason, round(cc, 6) AS causal_confidence, rk::INTEGER AS causal_rank FROM rank1""",
    "localize": f"""SELECT node_id, node_type, {REASON} AS inclusion_reason,
        NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = c.node_id AND e.target_id IN (SELECT node_id FROM cands)) AS is_potential_origin
        FROM cands c""",
    "span_signals": """SELECT node_id, count(*) AS spans, count(*) FILTER (WHERE err) AS errors, count(*) FILTER (WHERE nn = 9) AS db_spans,
        coalesce(bool_or(code = 503), FALSE) AS has_503, coalesce(bool_or(code = 429), FALSE) AS has_429, coalesce(bool_or(code = 200), FALSE) AS has_200,
        bool_or(etype LIKE '%timeout%' OR etype LIKE '%connection%') AS has_timeout,
        round(max(duration_ms) FILTER (WHERE nn = 9), 6) AS slowest_db_ms FROM win GROUP BY 1""",
    "neighbour_hints": """
        SELECT node_id, signal, direction, CASE WHEN signal IN ('error_code_pattern', 'silent_degradation', 'change_event') THEN 'strong' ELSE 'moderate' END AS hint_strength,
               CASE signal
                 WHEN 'error_code_pattern' THEN node_id || ': ' || concat_ws(', ',
                   CASE WHEN h503 OR h429 THEN 'status ' || concat_ws('/', CASE WHEN h429 THEN '429' END, CASE WHEN h503 THEN '503' END) END,
                   CASE WHEN tmo THEN 'failed connections' END)
                 WHEN 'silent_degradation' THEN suspect || ' fails although ' || node_id || ' answers with 200; its answers may be unusable'
                 WHEN 'change_event' THEN node_id || ': changed, and failing since'
                 WHEN 'missing_telemetry' THEN node_id || ': failing spans, yet no metric that would show it'
                 WHEN 'sub_threshold_metric' THEN node_id || ': changed, and a metric moved without crossing the threshold'
                 ELSE node_id || ': failing spans' END AS reason,
               suspect AS suggesting_node_id
        FROM hints1""",
    "iterations": f"""SELECT node_id, it::INTEGER AS iteration, rk::INTEGER AS causal_rank, {REASON} AS inclusion_reason, origin AS is_potential_origin,
        round(cc, 6) AS causal_confidence FROM loop""",
    "worst_operation": "SELECT node_id, op AS operation, round(errors / total, 6) AS rate, errors, total FROM worst",
    "exception_freq": "SELECT node_id, exc_type AS exception_type, n AS occurrences FROM exc",
    "first_exception": "SELECT node_id, arg_min(exc_type, ord) AS exception_type, arg_min(exc_msg, ord) AS exception_message FROM win WHERE err GROUP BY 1",
    "slowest_statement": """SELECT node_id, stmt AS slow_statement, round(avg(duration_ms), 6) AS slow_mean_ms, count(*) AS slow_count FROM win
        WHERE stmt IS NOT NULL GROUP BY node_id, stmt QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY avg(duration_ms) DESC, min(ord)) = 1""",
    "failing_statement": """SELECT node_id, stmt AS error_statement, count(*) AS error_statement_count FROM win
        WHERE stmt IS NOT NULL AND err GROUP BY node_id, stmt QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, min(ord)) = 1""",
    "error_pattern": """SELECT s.node_id, coalesce(arg_max(exc_type, (n, -first)), 'elevated error rate') AS error_pattern
        FROM services s LEFT JOIN exc USING (node_id) GROUP BY 1""",
    "status_histogram": "SELECT node_id, code AS http_code, calls FROM calls",
    "caller_timeouts": """
        , tmo AS (SELECT node_id, arg_max(exc_type, (n, -first)) AS t FROM exc
                  WHERE exc_type LIKE '%Timeout%' OR exc_type LIKE '%ConnectionPool%' OR exc_type LIKE '%Exhausted%' GROUP BY 1)
        SELECT target_id AS node_id, source_id AS caller_id, t AS timeout_type, (row_number() OVER (PARTITION BY target_id ORDER BY ord))::INTEGER AS place
        FROM edges JOIN tmo ON tmo.node_id = source_id""",
    "evidence_database": f"SELECT {SHOW} FROM ev_db",
    "evidence_dependency": f"SELECT {SHOW} FROM ev_dep",
    "evidence_service_code": f"SELECT {SHOW} FROM ev_code",
    "evidence_service_config": f"SELECT {SHOW} FROM ev_config",
    "evidence_assessed": """SELECT node_id, 'llm_config_assessment' AS signal, CASE o_orderkey % 7 WHEN 0 THEN 'strong' ELSE 'weak' END AS strength, place AS item
        FROM settings WHERE place <= 3 AND o_orderkey % 7 IN (0, 1)""",
    "database_findings": "SELECT node_id, domain, failure_type, priority::DOUBLE AS priority_score FROM findings WHERE domain = 'database'",
    "finding_texts": """
        SELECT 'n11' AS node_id, 'http_error_pattern' AS signal, calls || ' of ' || (SELECT sum(calls) FROM calls) || ' calls to n11 came back as ' || code || ' within 5 min' AS finding
        FROM calls WHERE code BETWEEN 500 AND 599
        UNION ALL SELECT 'n11', 'all_callers_affected', affected || ' of ' || callers || ' services that call n11 suffer' || CASE WHEN affected = callers THEN ', that is all' ELSE '' END FROM scope
        UNION ALL SELECT node_id, 'db_integrity_error', exc_type || ' reported by ' || node_id || ': ' || exc_msg FROM (
            SELECT node_id, arg_min(exc_type, ord) AS exc_type, arg_min(exc_msg, ord) AS exc_msg FROM win WHERE nn = 9 AND exc_type = 'UniqueViolation' GROUP BY 1)""",
    "dependency_findings": "SELECT node_id, domain, failure_type, priority::DOUBLE AS priority_score FROM findings WHERE domain = 'dependency'",
    "queue_findings": "SELECT node_id, domain, failure_type, priority::DOUBLE AS priority_score FROM findings WHERE domain = 'queue'",
    "latest_deploy": """SELECT node_id, event_id AS deploy_id, 'v' || (o_orderkey % 10) AS version,
        CASE WHEN o_orderkey % 2 = 0 THEN 'touches fn' || (o_orderkey % 8) END AS diff_summary, round(minutes, 6)::DOUBLE AS deploy_minutes FROM deploys""",
    "service_arbitration": """SELECT node_id, domain, failure_type, priority::DOUBLE AS priority_score, winner, "both" AS both_strong
        FROM findings WHERE winner IS NOT NULL""",
    "diff_lines": """SELECT 'commit-' || l_orderkey AS event_id, kind, new_line, CASE WHEN kind <> '+' THEN old_at END AS old_line, text, (rn + CASE WHEN rn > 2 THEN 3 ELSE 2 END)::INTEGER AS pos,
        CASE WHEN rn > 2 THEN 2 ELSE 1 END AS hunk FROM dlines""",
    "function_changes": """
        , newl AS (SELECT l_orderkey, new_line, text FROM dlines WHERE kind <> '-'), oldl AS (SELECT l_orderkey, old_at, text FROM dlines WHERE kind <> '+')
        , spread AS (SELECT fu.*, i, o.text AS old_text, n.text AS new_text
           FROM (SELECT fu.*, s.old_from, s.new_from, unnest(range(5)) AS i FROM funcs fu JOIN syms s USING (f)) fu
           LEFT JOIN oldl o ON o.l_orderkey = fu.l_orderkey AND o.old_at = fu.old_from + i
           LEFT JOIN newl n ON n.l_orderkey = fu.l_orderkey AND n.new_line = fu.new_from + i)
        SELECT 'commit-' || l_orderkey AS event_id, 'src/mod' || (l_orderkey % 6) || '.py' AS file_path, 'python' AS language, 'fn' || f AS function_name,
               change_type, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line,
               CASE WHEN has_old THEN string_agg(coalesce(old_text, ''), chr(10) ORDER BY i) END AS old_code,
               CASE WHEN has_new THEN string_agg(coalesce(new_text, ''), chr(10) ORDER BY i) END AS new_code
        FROM spread GROUP BY l_orderkey, f, change_type, start_line, end_line, has_old, has_new""",
    "stack_frames": "SELECT node_id, span_id, 0::INTEGER AS pos, file_path, function_name, line AS line_number, base FROM frames",
    "stack_match": """SELECT node_id, CASE rank WHEN 0 THEN 'exact_line' WHEN 1 THEN 'function_match' ELSE 'file_match' END AS match_type, span_id,
        line AS frame_line, event_id AS commit_event_id, function_name, 'src/' || base AS file_path FROM matches""",
    "assessment_parse": """SELECT 'chg-' || o_orderkey AS ref_id, CASE o_orderkey % 7 WHEN 0 THEN 'likely' WHEN 1 THEN 'unlikely' ELSE 'uncertain' END AS assessment,
        CASE WHEN o_orderkey % 7 < 2 THEN 'r' || o_orderkey WHEN o_orderkey % 7 = 5 THEN 'unclear' ELSE 'parse error' END AS reasoning,
        CASE WHEN o_orderkey % 7 = 0 THEN 'a,' || o_custkey || ',True' ELSE '' END AS signals FROM orders""",
    "assessment_requests": """
        , firsts AS (SELECT node_id, arg_min(exc_type, ord) AS t, arg_min(exc_msg, ord) AS m FROM win WHERE err GROUP BY 1)
        , newl AS (SELECT l_orderkey, new_line, text FROM dlines WHERE kind <> '-'), oldl AS (SELECT l_orderkey, old_at, text FROM dlines WHERE kind <> '+')
        , spread AS (SELECT m.*, x.has_old, x.has_new, i, o.text AS old_text, n.text AS new_text
           FROM (SELECT m.*, s.old_from, s.new_from, unnest(range(5)) AS i FROM matches m JOIN syms s USING (f)) m
           JOIN funcs x ON x.l_orderkey = m.o_orderkey AND x.f = m.f AND (x.change_type = 'deleted') = m.del
           LEFT JOIN oldl o ON o.l_orderkey = m.o_orderkey AND o.old_at = m.old_from + i
           LEFT JOIN newl n ON n.l_orderkey = m.o_orderkey AND n.new_line = m.new_from + i)
        , code AS (SELECT node_id, event_id, function_name, base, rank, line,
                          CASE WHEN has_old THEN string_agg(coalesce(old_text, ''), chr(10) ORDER BY i) END AS old_code,
                          CASE WHEN has_new THEN string_agg(coalesce(new_text, ''), chr(10) ORDER BY i) END AS new_code
                   FROM spread GROUP BY node_id, event_id, function_name, base, rank, line, has_old, has_new)
        , patterns AS (SELECT s.node_id, coalesce(arg_max(exc_type, (n, -first)), 'elevated error rate') AS p FROM services s LEFT JOIN exc USING (node_id) GROUP BY 1)
        SELECT node_id AS service_id, 'deploy_exception' AS kind, event_id AS ref_id,
               concat_ws(chr(10), 'Deploy diff summary: touches fn' || (o_orderkey % 8), 'Service: ' || node_id, 'Deploy version: v' || (o_orderkey % 10),
                         'Exception type: ' || t, 'Exception message: ' || m) AS message
        FROM deploys JOIN firsts USING (node_id) WHERE o_orderkey % 2 = 0 AND node_id IN (SELECT node_id FROM services)
        UNION ALL
        SELECT node_id, 'code_match', event_id,
               concat_ws(chr(10), 'Service: ' || node_id, 'Function: ' || function_name, 'File: src/' || base,
                         'Match type: ' || CASE rank WHEN 0 THEN 'exact_line' WHEN 1 THEN 'function_match' ELSE 'file_match' END,
                         '', 'OLD CODE:', old_code, '', 'NEW CODE:', new_code, '', 'Exception type: ' || t, 'Exception at line: ' || line, 'Exception message: ' || m)
        FROM code JOIN firsts USING (node_id) WHERE old_code <> '' AND new_code <> ''
        UNION ALL
        SELECT s.node_id, 'setting_change', event_id,
               concat_ws(chr(10), CASE kind WHEN 'feature_flag' THEN 'Change type: feature_flag' ELSE 'Change type: config' END,
                         CASE kind WHEN 'feature_flag' THEN 'Flag key: key' ELSE 'Config key: key' END || (o_orderkey % 20),
                         'Old value: ' || o_orderstatus, 'New value: x' || (o_orderkey % 3), 'Error pattern: ' || p)
        FROM settings s JOIN patterns USING (node_id) WHERE place <= 3""",
    "narrative_requests": """
        SELECT 'inc-1' AS incident_id, (c.items + 9)::INTEGER AS narrative_lines,
               concat_ws(chr(10), 'Recommend a fix for this production incident.', 'Incident ID: inc-1', 'Root cause: ' || c.node_id || ' (' || n.node_type || ')',
                         'Domain: ' || domain, 'Failure type: ' || failure_type, 'Confidence: ' || cents || '%') AS fix_head
        FROM causes c JOIN nodes n USING (node_id) WHERE c.score_rank = (SELECT min(score_rank) FROM causes)""",
    "score": """SELECT node_id, domain, failure_type, (cents / 100)::DOUBLE AS domain_confidence, items AS evidence_count, strong AS strong_count,
        score_rank::INTEGER AS score_rank, it::INTEGER AS iteration FROM scored""",
    "multi_factor": """SELECT len(domains) >= 2 AS multi_factor_flagged, (CASE WHEN len(domains) >= 2 THEN 0.5 ELSE 0.0 END)::DOUBLE AS residual_unexplained,
        CASE WHEN len(domains) >= 2 THEN 'strong evidence in two domains: ' || domains[1] || ', ' || domains[2]
             ELSE 'one domain explains it' END AS explanation FROM multi""",
    "verdict": """SELECT 'inc-1' AS incident_id, verdict, (SELECT node_id FROM causes ORDER BY score_rank LIMIT 1) AS root_cause_node,
        (SELECT domain FROM causes ORDER BY score_rank LIMIT 1) AS root_cause_domain,
        coalesce((SELECT cents / 100 FROM causes ORDER BY score_rank LIMIT 1), 0)::DOUBLE AS confidence,
        coalesce((SELECT string_agg(node_id, ',' ORDER BY score_rank) FROM causes), '') AS root_cause_ids,
        (SELECT max(it) FROM scored)::INTEGER AS iterations_run, CASE WHEN (SELECT count(*) FROM anom) > 0 THEN 'high' ELSE 'low' END AS data_quality,
        CASE WHEN verdict = 'multi_factor' THEN 'two causes: ' || (SELECT string_agg(domain || ' (' || node_id || ')', ', ' ORDER BY score_rank) FROM causes) END AS multi_factor_explanation,
        CASE WHEN verdict = 'no_root_cause_found' THEN (SELECT string_agg(node_id, ',' ORDER BY score_rank) FROM scored) ELSE '' END AS weak_signals
        FROM verdicts""",
    "result_documents": """SELECT 'inc-1' AS incident_id, verdict = 'root_cause_found' AS has_root_cause, (SELECT node_id FROM causes ORDER BY score_rank LIMIT 1) AS root_cause_node,
        (SELECT string_agg(node_id, ',' ORDER BY score_rank) FROM scored WHERE score_rank <= 3) AS root_causes,
        (SELECT count(*) FROM scored)::INTEGER AS candidates, (SELECT items FROM scored WHERE score_rank = 1)::INTEGER AS top_evidence,
        (SELECT round(cc, 4) FROM scored WHERE score_rank = 1) AS top_causal, (SELECT count(*) FROM spans) AS span_count FROM verdicts""",
    "result_summaries": """SELECT 'inc-1' AS incident_id, verdict = 'root_cause_found' AS has_root_cause,
        coalesce((SELECT cents / 100 FROM causes ORDER BY score_rank LIMIT 1), 0)::DOUBLE AS confidence,
        (SELECT node_id FROM scored WHERE score_rank = 1) AS top_candidate, (SELECT domain FROM scored WHERE score_rank = 1) AS domain FROM verdicts""",
    "result_lookup": """
        WITH stored AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 12, '0') ELSE c_custkey::VARCHAR END AS incident_id,
                               CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS narrative FROM customer)
        SELECT * FROM stored UNION ALL SELECT 'lookup of ' || incident_id, narrative FROM stored WHERE incident_id IN ('12', '000000000012', '7')""",
    "result_feedback": """
        SELECT 'inc-1' AS incident_id, arg_max(o_orderstatus = 'F', (epoch_us(o_orderdate) + o_orderkey, o_orderstatus = 'F', 'note ' || o_orderkey)) AS correct,
               arg_max('note ' || o_orderkey, (epoch_us(o_orderdate) + o_orderkey, o_orderstatus = 'F', 'note ' || o_orderkey)) AS notes, 1::BIGINT AS n
        FROM orders WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT 'inc-unknown', NULL, NULL, count(*) FROM orders WHERE o_orderkey % 4 = 0""",
}


def _assemble(sql: str) -> str:
    """Queries that start with a comma bring CTEs of their own."""
    text = sql.strip()
    if not text.startswith(","):
        return _with(text)
    needed = _with("SELECT 1 FROM " + " JOIN ".join(_uses(text)))
    return needed.rsplit("\nSELECT 1 FROM", 1)[0] + "\n" + text


ORACLE = {name: _assemble(sql) for name, sql in CHECKS.items()}
