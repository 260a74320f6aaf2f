"""Telemetry derived from the driver tables.

The tables hold no telemetry, so the registered queries read these views: every
event is a metric sample, every line item a span (an order's fifth and later ones
are further children of its third), every order a change event or a commit. All
rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import Params

INCIDENT_START = "2024-01-25 00:00:00"
# The sampled telemetry is sparse, so the incident window spans three days and
# the coupling bucket one day.
VIEW_PARAMS = Params(window_seconds=3 * 86400, bucket_seconds=86400, chunk_seconds=86400)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession) -> DataFrame:
    return spark.sql(
        f"SELECT 'inc-1' AS incident_id, TIMESTAMP '{INCIDENT_START}' AS incident_start, 5 AS top_k"
    )


#: Starts of several incidents: before, between and after each other's windows.
STARTS = ("2024-01-05 00:00:00", "2024-01-09 07:30:00", "2024-01-10 00:00:00", "2024-01-25 00:00:00", "2024-01-29 18:45:00")
#: Starts of incidents whose graphs come from one or two days of spans.
GRAPH_STARTS = ("2024-01-24 01:00:00", "2024-01-25 02:00:00", "2024-01-24 23:30:00", "2024-01-26 01:00:00")
GRAPH_PARAMS = VIEW_PARAMS.but(window_seconds=3600, graph_lookback_days=0)


def several(spark: SparkSession, starts: tuple[str, ...]) -> DataFrame:
    """Incidents s1, s2, ... at the given starts."""
    return spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(starts, 1)], "incident_id string, at string").selectExpr(
        "incident_id", "CAST(at AS TIMESTAMP) AS incident_start", "5 AS top_k"
    )


def region_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph per region: each nation calls the next of its region, the last one the first in regions 0 and 2."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('r', n_regionkey) AS incident_id", "n_regionkey", "concat('n', n_nationkey) AS source_id",
        "concat('n', lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS following",
        "concat('n', min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS first",
    ).selectExpr("incident_id", "source_id", "coalesce(following, CASE WHEN n_regionkey IN (0, 2) THEN first END) AS target_id").where("target_id IS NOT NULL")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('n', user_id % 12) AS node_id",
        "CASE user_id % 12 WHEN 9 THEN 'database' WHEN 10 THEN 'queue' WHEN 11 THEN 'external_dep' ELSE 'service' END AS node_type",
        """CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'view' THEN 'latency_p99'
             WHEN 'click' THEN 'request_rate' WHEN 'purchase' THEN 'latency_p50' ELSE 'saturation' END AS metric_type""",
        f"""CASE WHEN ts >= TIMESTAMP '{INCIDENT_START}' AND event_type IN ('error', 'view')
             AND user_id % 12 IN (3, 4, 9, 11) THEN value * 10 ELSE value END AS value""",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "60 AS window_seconds",
        "'u' AS unit",
        "event_id AS ord",
    )


#: Order of the line items within their order.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their order (an order has a handful)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*", f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rn"
    )


def spans(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Spans, with further columns of their line items on request."""
    base = (
        numbered_lines(spark, sf_dir)
        .selectExpr("*", "least(rn, 4) AS tier", "(least(rn, 4) - 1) * 3 + l_suppkey % 3 AS nn")
        .selectExpr(
            "*",
            "l_returnflag = 'R' AND nn <> 7 AS err",
            "nn IN (6, 7, 8) AND l_linenumber % 2 = 0 AS calls_out",
            """unix_micros(TIMESTAMP '2024-01-24 00:00:00')
               + ((l_orderkey * 7919) % 172800 + rn) * 1000000 AS start_us""",
        )
    )
    none = "CAST(NULL AS STRING)"
    attributes = {
        "http.status_code": """CASE WHEN nn = 1 OR nn IN (9, 10) THEN NULL
            WHEN NOT err THEN '200' WHEN nn = 0 OR nn = 11 OR calls_out THEN '503'
            WHEN nn = 2 THEN '429' ELSE '500' END""",
        "http.response.status_code": "CASE WHEN nn = 1 THEN CASE WHEN err THEN '502' ELSE '200' END END",
        "http.scheme": "CASE WHEN nn <= 8 THEN 'http' END",
        "db.system": "CASE WHEN nn = 9 THEN 'PostgreSQL' END",
        "db.name": "CASE WHEN nn = 9 THEN 'n9' END",
        "db.statement": "CASE WHEN nn = 9 THEN concat('SELECT * FROM t', l_partkey % 7, ' WHERE id = ?') END",
        "messaging.system": "CASE WHEN nn = 10 THEN 'kafka' END",
        "messaging.destination": "CASE WHEN nn = 10 THEN 'n10' END",
        "peer.service": "CASE WHEN nn = 11 OR calls_out THEN 'n11' END",
        "server.address": "CASE WHEN nn = 11 THEN concat('ext-', l_partkey % 5) END",
        "error.type": "CASE WHEN err AND nn = 5 THEN 'ConnectionTimeout' WHEN err AND nn = 3 THEN 'ValueError' END",
    }
    entries = ", ".join(
        f"struct('{k}' AS key, {v if v else none} AS value)" for k, v in attributes.items()
    )
    return base.selectExpr(
        "concat('t', l_orderkey) AS trace_id",
        "concat('s', l_orderkey, '-', rn) AS span_id",
        "CASE WHEN rn > 1 THEN concat('s', l_orderkey, '-', tier - 1) END AS parent_span_id",
        "concat('n', nn) AS service_id",
        "concat('op', l_partkey % 5) AS operation_name",
        "timestamp_micros(start_us) AS start_time",
        "timestamp_micros(start_us + CAST(round(l_extendedprice * 10, 0) AS BIGINT)) AS end_time",
        "round(l_extendedprice * 10, 0) / 1000 AS duration_ms",
        """CASE WHEN nn = 9 OR nn = 11 OR calls_out THEN 'client' WHEN nn = 10 THEN 'producer'
             ELSE 'server' END AS kind""",
        "CASE WHEN err THEN 2 ELSE 0 END AS otel_status_code",
        """CASE WHEN nn = 1 THEN CASE WHEN err THEN 502 ELSE 200 END WHEN nn IN (9, 10) THEN NULL
             WHEN NOT err THEN 200 WHEN nn = 0 OR nn = 11 OR calls_out THEN 503
             WHEN nn = 2 THEN 429 ELSE 500 END AS http_status_code""",
        f"map_from_entries(filter(array({entries}), e -> e.value IS NOT NULL)) AS attributes",
        """CASE WHEN err THEN array(named_struct(
             'name', 'exception',
             'time_unix_nano', CAST(start_us * 1000 AS STRING),
             'attributes', map(
               'exception.type', CASE WHEN nn = 9 AND l_partkey % 5 = 0 THEN 'UniqueViolation'
                   WHEN l_partkey % 4 = 0 THEN 'NullPointerException'
                   WHEN l_partkey % 4 = 1 THEN 'TimeoutError'
                   WHEN l_partkey % 4 = 2 THEN 'ConnectionPoolExhausted' ELSE 'ValueError' END,
               'exception.message', concat('order ', l_orderkey),
               'exception.stacktrace', CASE l_partkey % 3
                 WHEN 0 THEN concat('Traceback:\n  File "/srv/app/mod', l_partkey % 6, '.py", line ',
                     l_partkey % 40 + 1, ', in fn', l_suppkey % 8, '\n')
                 WHEN 1 THEN concat('Boom\n\tat com.acme.Svc.fn', l_suppkey % 8, '(mod', l_partkey % 6, '.py:',
                     l_partkey % 40 + 1, ')\n')
                 ELSE concat('Error: x\n    at /srv/app/mod', l_partkey % 6, '.py:', l_partkey % 40 + 1, ':13\n')
                 END)))
           ELSE CAST(array() AS ARRAY<STRUCT<name: STRING, time_unix_nano: STRING, attributes: MAP<STRING, STRING>>>)
           END AS events""",
        """map('service.name', concat('n', nn), 'service.version', concat('1.', l_partkey % 3),
               'deployment.environment', concat('env', l_orderkey % 3)) AS resource_attributes""",
        "CAST(l_orderkey AS BIGINT) * 1000 + rn AS ord",
        *also,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = """CASE o_orderpriority WHEN '1-URGENT' THEN 'deploy' WHEN '2-HIGH' THEN 'config_change'
               WHEN '4-NOT SPECIFIED' THEN 'config_change' ELSE 'feature_flag' END"""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            f"{kind} AS kind",
            "concat('chg-', o_orderkey) AS event_id",
            "concat('n', o_custkey % 9) AS service_id",
            f"""timestamp_micros(unix_micros(TIMESTAMP '{INCIDENT_START}')
                 - ((o_orderkey * 7919) % 5400) * 1000000) AS timestamp""",
            f"CASE WHEN {kind} = 'deploy' THEN concat('v', o_orderkey % 10) END AS version",
            f"CASE WHEN {kind} = 'config_change' THEN 'update' END AS change_type",
            f"CASE WHEN {kind} <> 'deploy' THEN concat('key', o_orderkey % 20) END AS key",
            f"CASE WHEN {kind} = 'deploy' THEN NULL ELSE o_orderstatus END AS old_value",
            f"CASE WHEN {kind} = 'deploy' THEN NULL ELSE concat('x', o_orderkey % 3) END AS new_value",
            "concat('dev', o_custkey % 50) AS author",
            f"CASE WHEN {kind} = 'deploy' AND o_orderkey % 2 = 0 THEN concat('touches fn', o_orderkey % 8) END AS diff_summary",
            f"CASE WHEN {kind} = 'deploy' THEN array(concat('n', o_custkey % 9)) END AS deploy_scope",
            "map('team', concat('team', o_custkey % 4)) AS tags",
            "o_orderkey AS ord",
        )
    )


def service_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code access per service, from the suppliers behind it."""
    return (
        table(spark, sf_dir, "supplier")
        .selectExpr("concat('n', s_suppkey % 9) AS node_id", "s_suppkey")
        .groupBy("node_id")
        .agg(F.min("s_suppkey").alias("first_supplier"))
        .selectExpr(
            "node_id",
            "first_supplier % 4 <> 3 AS code_access_enabled",
            "concat('https://git.example.org/', node_id) AS repo_url",
        )
    )


def commit_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unified diff per order; every line item is one diff line, the third and later ones in a second hunk."""
    lines = numbered_lines(spark, sf_dir).selectExpr(
        "l_orderkey",
        "rn",
        """concat(CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE ' ' END,
                  'x', l_partkey, ' = ', l_suppkey) AS line""",
    )
    return (
        lines.groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("ls"))
        .selectExpr(
            "concat('commit-', l_orderkey) AS event_id",
            "concat('src/mod', l_orderkey % 6, '.py') AS file_path",
            "'modified' AS change_type",
            "CAST(NULL AS STRING) AS old_path",
            """concat('--- a/f\n+++ b/f\n@@ -', l_orderkey % 30 + 1, ',', least(size(ls), 2), ' +',
                      l_orderkey % 30 + 3, ',', least(size(ls), 2), ' @@\n',
                      array_join(transform(slice(ls, 1, 2), x -> x.line), '\n'),
                      CASE WHEN size(ls) > 2 THEN concat('\n@@ -', l_orderkey % 30 + 8, ' +', l_orderkey % 30 + 11, ' @@ part two\n',
                      array_join(transform(slice(ls, 3, size(ls)), x -> x.line), '\n')) ELSE '' END) AS raw_diff""",
            "l_orderkey AS ord",
        )
    )


def symbols(diffs: DataFrame) -> DataFrame:
    """Function ranges of both file versions: five lines per function."""
    sides = diffs.selectExpr(
        "event_id", "file_path", "explode(array('old', 'new')) AS side"
    )
    return sides.selectExpr(
        "event_id", "file_path", "side", "explode(sequence(0, 7)) AS f"
    ).selectExpr(
        "event_id",
        "file_path",
        "side",
        "concat('fn', f) AS function_name",
        "f * 5 + CASE side WHEN 'old' THEN 1 ELSE 2 END AS start_line",
        "f * 5 + CASE side WHEN 'old' THEN 5 ELSE 6 END AS end_line",
        "CAST(f AS BIGINT) AS ord",
    ).where("NOT (side = 'old' AND function_name = 'fn6') AND NOT (side = 'new' AND function_name = 'fn1')")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit metadata per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('commit-', o_orderkey) AS event_id",
        "concat('n', o_custkey % 9) AS service_id",
        "sha1(CAST(o_orderkey AS STRING)) AS commit_sha",
        "concat('https://git.example.org/n', o_custkey % 9) AS repo_url",
        "'main' AS branch",
        "concat('dev', o_custkey % 50) AS author",
        "concat('change ', o_orderkey) AS commit_message",
        "CAST(NULL AS STRING) AS deploy_event_id",
        f"""timestamp_micros(unix_micros(TIMESTAMP '{INCIDENT_START}')
             - ((o_orderkey * 104729) % 5400) * 1000000) AS timestamp""",
        "o_orderkey AS ord",
    )


def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace records as a collector would send them, some of them broken.

    An order is a trace. Its spans are put together where the order's lines were
    numbered, so that only the narrow lines are shuffled and nothing is sorted again.
    """
    pairs = "transform(map_entries({m}), e -> named_struct('key', e.key, 'value', named_struct('stringValue', e.value)))"
    number = "map('internal', 1, 'server', 2, 'client', 3, 'producer', 4, 'consumer', 5)[kind]"
    entry = f"""named_struct(
        'resource', named_struct('attributes', {pairs.format(m='resource_attributes')}),
        'scopeSpans', array(named_struct('spans', array(named_struct(
            'traceId', trace_id,
            'spanId', CASE WHEN ord % 101 = 0 THEN '' ELSE span_id END,
            'parentSpanId', coalesce(parent_span_id, ''),
            'name', operation_name,
            'kind', {number},
            'startTimeUnixNano', CASE WHEN ord % 107 = 0 THEN 'soon' ELSE CAST(unix_micros(start_time) * 1000 AS STRING) END,
            'endTimeUnixNano', CAST((unix_micros(end_time) - CASE WHEN ord % 103 = 0 THEN 86400000000 ELSE 0 END) * 1000 AS STRING),
            'attributes', {pairs.format(m='attributes')},
            'status', named_struct('code', otel_status_code),
            'events', transform(events, e -> named_struct('name', e.name, 'timeUnixNano', e.time_unix_nano,
                'attributes', {pairs.format(m='e.attributes')}))
        )))))"""
    trace = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        spans(spark, sf_dir, "l_orderkey", "rn", *LINE_ORDER)
        .selectExpr("l_orderkey", "rn", *LINE_ORDER, "ord", f"struct(ord, {entry} AS entry) AS e")
        .select("rn", F.collect_list("e").over(trace).alias("es"), F.min("ord").over(trace).alias("ord"))
        .where("rn = 1")
        .select(
            F.to_json(F.struct(F.transform(F.array_sort("es"), lambda e: e["entry"]).alias("resourceSpans"))).alias("raw"), "ord"
        )
    )


def raw_metrics(metrics_view: DataFrame) -> DataFrame:
    """Metric records, a few per hundred of them broken or oddly typed."""
    m = "ord % 50"
    return metrics_view.selectExpr(
        f"""concat('{{"node_id":"', node_id, '","node_type":"', CASE WHEN {m} = 4 THEN 'vm' ELSE node_type END,
            '","metric_type":"', metric_type, '","value":',
            CASE WHEN {m} = 1 THEN 'true' WHEN {m} = 2 THEN concat('"', value, '"') WHEN {m} = 6 THEN '-1'
                 ELSE CAST(value AS STRING) END,
            ',"timestamp":"', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            CASE WHEN {m} = 3 THEN '"' ELSE 'Z"' END, ',"window_seconds":',
            CASE WHEN {m} = 5 THEN '0' WHEN {m} = 8 THEN '60.7' WHEN {m} = 9 THEN '"60"' ELSE '60' END,
            CASE WHEN {m} = 7 THEN '}}' ELSE ',"unit":"u"}}' END) AS raw""",
        "ord",
    )


def raw_changes(changes_view: DataFrame) -> DataFrame:
    """Change records from the inverse serialiser, some of them broken."""
    from ..sources.changes import to_records

    m = F.col("ord") % 40
    raw = F.col("raw")
    return to_records(changes_view).withColumn(
        "raw",
        F.when(m == 1, F.regexp_replace(raw, '"service_id":"[^"]*"', '"service_id":""'))
        .when(m == 2, F.regexp_replace(raw, '"event_type":"[^"]*"', '"event_type":"rollback"'))
        .when(m == 3, F.regexp_replace(raw, '"timestamp":"[^"]*"', '"timestamp":"yesterday"'))
        .when(m == 4, F.regexp_replace(raw, r'"deploy_scope":\[[^\]]*\]', '"deploy_scope":"all"'))
        .otherwise(raw),
    )


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit metadata records, one per order, some of them broken."""
    stamp = """concat(date_format(CAST(o_orderdate AS TIMESTAMP), "yyyy-MM-dd'T'HH:mm:ss"), CASE o_orderkey % 3 WHEN 0 THEN 'Z' ELSE '+02:00' END)"""
    return table(spark, sf_dir, "orders").selectExpr(
        f"""to_json(named_struct('event_id', concat('commit-', o_orderkey), 'commit_sha', CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE md5(CAST(o_orderkey AS STRING)) END,
            'repo_url', concat('https://h/', o_custkey), 'branch', 'main', 'author', concat('dev', o_custkey % 50), 'commit_message', concat('m', o_orderkey),
            'deploy_event_id', CASE WHEN o_orderkey % 2 = 0 THEN concat('chg-', o_orderkey) END,
            'timestamp', CASE WHEN o_orderkey % 31 = 0 THEN 'now' ELSE {stamp} END)) AS raw""",
        "concat('n', o_custkey % 9) AS service_id", "CAST(o_orderkey AS BIGINT) AS ord",
    )


def stored_results(spark: SparkSession, sf_dir: str, narrative: str, condition: str = "true") -> DataFrame:
    """Result rows, one per customer, with ids that read like numbers."""
    return table(spark, sf_dir, "customer").where(condition).selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS STRING), 12, '0') ELSE CAST(c_custkey AS STRING) END AS incident_id", f"'{narrative}' AS narrative"
    )


def known_topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known nodes and edges from the nations and regions."""
    nodes = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey * 2) AS node_id", "'queue' AS node_type")
    edges = table(spark, sf_dir, "region").selectExpr(
        "concat('n', r_regionkey) AS source_id", "concat('n', r_regionkey + 3) AS target_id", "'depends_on' AS edge_type", "'known' AS protocol"
    )
    return nodes, edges


def raw_pushes(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """Push payloads of both shapes, one per order."""
    stamp = """concat(date_format(CAST(o_orderdate AS TIMESTAMP), "yyyy-MM-dd'T'HH:mm:ss"),
               CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-0530' END)"""
    body = {
        "github": f"""named_struct('ref', 'refs/heads/main', 'after', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE sha1(CAST(o_orderkey AS STRING)) END,
            'head_commit', named_struct('id', md5(CAST(o_orderkey AS STRING)), 'message', concat('m', o_orderkey), 'timestamp', {stamp}),
            'repository', named_struct('html_url', CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('https://h/', o_custkey) END),
            'pusher', named_struct('email', concat('u', o_custkey, '@example.org')))""",
        "gitlab": f"""named_struct('ref', 'refs/heads/rel/1', 'checkout_sha', sha1(CAST(o_orderkey AS STRING)),
            'project', named_struct('web_url', concat('https://l/', o_custkey)),
            'user_email', concat('u', o_custkey, '@example.org'),
            'commits', array(named_struct('message', concat('m', o_orderkey), 'timestamp', CASE WHEN o_orderkey % 37 = 0 THEN 'now' ELSE {stamp} END)))""",
    }[shape]
    return table(spark, sf_dir, "orders").selectExpr(
        f"to_json({body}) AS raw", "concat('n', o_custkey % 9) AS service_id", "o_orderkey AS ord"
    )


def raw_replies(orders: DataFrame) -> DataFrame:
    """Assessor replies per order: clean, fenced, and unusable ones."""
    return orders.selectExpr(
        "'inc-1' AS incident_id",
        "concat('n', o_custkey % 9) AS service_id",
        "'setting_change' AS kind",
        "concat('chg-', o_orderkey) AS ref_id",
        """CASE o_orderkey % 7
             WHEN 0 THEN concat('{"causal_assessment":"likely","reasoning":"r', o_orderkey, '","signals":["a",', o_custkey, ',true]}')
             WHEN 1 THEN concat('```json\n{"causal_assessment":"unlikely","reasoning":"r', o_orderkey, '"}\n```')
             WHEN 2 THEN '{"causal_assessment":"maybe","reasoning":"x"}'
             WHEN 3 THEN '{"causal_assessment":"likely","reasoning":""}'
             WHEN 4 THEN concat('I think order ', o_orderkey, ' did it')
             WHEN 5 THEN '  {"causal_assessment":"uncertain","reasoning":"unclear","signals":"none"} '
             ELSE '{"causal_assessment":"likely","reasoning":7}' END AS raw_reply""",
    )
