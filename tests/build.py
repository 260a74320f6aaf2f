"""Small hand-written telemetry."""

from datetime import datetime, timedelta, timezone

from rootseek import schemas

START = datetime(2024, 1, 1, 12, 0, tzinfo=timezone.utc)


class Lake:
    """Collects rows in input order and turns them into tables."""

    def __init__(self):
        self.rows = {k: [] for k in ("spans", "metrics", "changes", "commits", "functions", "config", "replies", "incidents")}

    def span(self, service, start=None, error=False, parent=None, kind="server", op="op", ms=50.0, attrs=None,
             exceptions=(), span_id=None, resource=None, trace="t", http=None):
        n = len(self.rows["spans"])
        span_id = span_id or f"s{n}"
        start = start or START + timedelta(seconds=10)
        events = [
            ("exception", "0", {k: v for k, v in (("exception.type", t), ("exception.message", m), ("exception.stacktrace", st)) if v is not None})
            for t, m, st in exceptions
        ]
        self.rows["spans"].append(
            (trace, span_id, parent, service, op, start, start + timedelta(milliseconds=ms), float(ms), kind,
             2 if error else 0, http, attrs or {}, events, resource or {}, n)
        )
        return span_id

    def metric(self, node, kind, value, at):
        self.rows["metrics"].append((node, "service", kind, float(value), at, 60, "u", len(self.rows["metrics"])))

    def series(self, node, start, error=None, latency=None, rate=None, factor=1.0, error_now=None):
        """Ten quiet minutes, then one sample inside the incident window."""
        for i in range(10):
            at = start - timedelta(minutes=10 - i)
            wobble = 0.1 * (i % 3)
            if error is not None:
                self.metric(node, "error_rate", error + wobble, at)
            if latency is not None:
                self.metric(node, "latency_p99", latency + wobble, at)
            if rate is not None:
                self.metric(node, "request_rate", rate, at)
        now = start + timedelta(seconds=60)
        if error is not None:
            self.metric(node, "error_rate", error if error_now is None else error_now, now)
        if latency is not None:
            self.metric(node, "latency_p99", latency * factor, now)

    def change(self, kind, service, minutes_before, start=START, event_id=None, version=None, key=None, old="False",
               new="True", diff=None):
        n = len(self.rows["changes"])
        self.rows["changes"].append(
            (kind, event_id or f"c{n}", service, start - timedelta(minutes=minutes_before),
             (version or "v1.8.1") if kind == "deploy" else None, "update" if kind == "config_change" else None,
             None if kind == "deploy" else (key or f"key{n}"), None if kind == "deploy" else old,
             None if kind == "deploy" else new, "dev", diff, [service] if kind == "deploy" else None, {}, n)
        )

    def commit(self, service, minutes_before, event_id, start=START, deploy=None, functions=()):
        n = len(self.rows["commits"])
        self.rows["commits"].append(
            (event_id, service, "abc", "https://r", "main", None, "m", deploy, start - timedelta(minutes=minutes_before), n)
        )
        for i, (path, name, line, old, new) in enumerate(functions):
            self.rows["functions"].append((event_id, path, "python", name, "modified", line, line + 10, old, new, [n, 0, i]))

    def access(self, service, allowed=True):
        self.rows["config"].append((service, allowed, f"https://r/{service}"))

    def reply(self, incident, service, kind, ref, text):
        self.rows["replies"].append((incident, service, kind, ref, text))

    def incident(self, name, start=START, top_k=5):
        self.rows["incidents"].append((name, start, top_k))

    def tables(self, spark):
        schema = {
            "spans": schemas.SPANS, "metrics": schemas.METRICS, "changes": schemas.CHANGES, "commits": schemas.COMMITS,
            "functions": schemas.FUNCTION_CHANGES, "config": schemas.SERVICE_CONFIG, "replies": schemas.ASSESSMENTS,
            "incidents": schemas.INCIDENTS,
        }
        return {k: spark.createDataFrame(rows, schema[k]) for k, rows in self.rows.items()}


def rows(df, *cols):
    """Sorted tuples of the given columns."""
    return sorted([tuple(r[c] for c in cols) for r in df.select(*cols).collect()], key=repr)
