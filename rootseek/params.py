"""Tunable values of the analysis, with their defaults.

Fixed values: the numbers below decide results (thresholds, weights, windows)
and are stated together here; every operator takes them through ``Params``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # windows
    window_seconds: int = 300            # incident window: metrics and spans
    change_lookback_minutes: int = 60    # candidates and neighbours
    deploy_lookback_minutes: int = 30    # deploy attribution
    config_lookback_minutes: int = 15    # config / flag attribution
    # baselines
    ema_alpha: float = 0.3
    std_floor: float = 0.01
    min_samples: int = 3
    anomaly_z: float = 3.0
    z_floor: float = -5.0
    z_cap: float = 20.0
    # coupling and edge weights
    bucket_seconds: int = 60
    coupling_min_points: int = 3
    coupling_fallback: float = 0.5
    weight_error: float = 0.4
    weight_latency: float = 0.4
    weight_volume: float = 0.2
    volume_norm: float = 1000.0
    volume_default: float = 10.0
    # causal score
    alpha_fit: float = 0.6
    beta_counterfactual: float = 0.4
    latency_factor: float = 5.0
    fit_error_weight: float = 0.7
    fit_latency_weight: float = 0.3
    fit_without_data: float = 0.5
    severity_without_data: float = 0.5
    error_multiplier: float = 2.0
    min_error_pct: float = 1.0
    latency_multiplier: float = 2.0
    necessity: float = 0.25
    hop_decay: float = 0.15
    hop_floor: float = 0.1
    path_cutoff: int = 5
    # reasoning loop and verdict
    max_iterations: int = 3
    top_k: int = 5
    root_cause_threshold: int = 70       # cents of confidence
    multi_factor_threshold: int = 65
    strong_cents: int = 35
    moderate_cents: int = 15
    weak_cents: int = 5
    cap_cents: int = 95
    residual_multi_factor: float = 0.5
    # priority of a candidate after its domain was examined
    service_smoking_gun: float = 0.95
    service_strong: float = 0.20
    service_moderate: float = 0.10
    database_strong: float = 0.15
    database_moderate: float = 0.05
    dependency_everyone: float = 0.15
    dependency_some: float = 0.05
    # timeline
    origin_error_rate: float = 0.1
    origin_depth: int = 2
    unreachable_depth: int = 999
    # evidence
    deploy_strong_minutes: float = 15.0
    config_strong_minutes: float = 5.0
    config_moderate_minutes: float = 15.0
    error_z_strong: float = 5.0
    error_z_moderate: float = 3.0
    latency_strong: float = 3.0
    latency_moderate: float = 1.5
    query_strong: float = 3.0
    exhaustion_strong: float = 0.5
    http_strong: float = 0.5
    http_strong_minutes: float = 2.0
    http_minutes: float = 5.0            # duration stated for HTTP errors, whatever the window
    slow_span_ms: float = 100.0
    db_latency_z: float = 1.0
    caller_timeout_items: int = 2
    assessed_changes: int = 3
    line_tolerance: int = 3
    # physical layout
    graph_lookback_days: int = 7         # days before an incident whose spans make its graph, with stored folds
    chunk_seconds: int = 3600            # pre-aggregation cell of metric samples
    broadcast_rows: int = 100_000        # incident rows allowed in a broadcast

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()

# Vocabularies of the data model.
METRIC_TYPES = ("latency_p99", "latency_p50", "error_rate", "request_rate", "consumer_lag", "saturation")
NODE_TYPES = ("service", "database", "queue", "external_dep")
ANOMALY_METRICS = ("error_rate", "latency_p99")
CHANGE_KINDS = ("deploy", "config_change", "feature_flag")
TIMEOUT_WORDS = ("timeout", "connection")
TIMEOUT_EXCEPTIONS = ("Timeout", "ConnectionPool", "Exhausted")
INTEGRITY_EXCEPTIONS = ("Constraint", "Unique", "ForeignKey", "Violation", "Deadlock")
RELATIONAL_SYSTEMS = ("postgresql", "mysql", "mariadb")
CACHE_SYSTEMS = ("redis", "memcached")
WRITE_OPERATIONS = ("INSERT", "UPDATE", "DELETE", "WRITE")
