"""Column types of the telemetry tables."""

EVENT = "struct<name:string,time_unix_nano:string,attributes:map<string,string>>"

SPANS = f"""trace_id string, span_id string, parent_span_id string, service_id string,
operation_name string, start_time timestamp, end_time timestamp, duration_ms double, kind string,
otel_status_code int, http_status_code int, attributes map<string,string>, events array<{EVENT}>,
resource_attributes map<string,string>, ord bigint"""

METRICS = """node_id string, node_type string, metric_type string, value double, timestamp timestamp,
window_seconds int, unit string, ord bigint"""

CHANGES = """kind string, event_id string, service_id string, timestamp timestamp, version string,
change_type string, key string, old_value string, new_value string, author string,
diff_summary string, deploy_scope array<string>, tags map<string,string>, ord bigint"""

COMMITS = """event_id string, service_id string, commit_sha string, repo_url string, branch string,
author string, commit_message string, deploy_event_id string, timestamp timestamp, ord bigint"""

FUNCTION_CHANGES = """event_id string, file_path string, language string, function_name string,
change_type string, start_line int, end_line int, old_code string, new_code string, ord array<bigint>"""

SERVICE_CONFIG = "node_id string, code_access_enabled boolean, repo_url string"

ASSESSMENTS = "incident_id string, service_id string, kind string, ref_id string, raw_reply string"

FEEDBACK = "incident_id string, correct boolean, notes string, submitted_at timestamp"

INCIDENTS = "incident_id string, incident_start timestamp, top_k int"
