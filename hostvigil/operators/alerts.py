"""Alerts: dispatch rules, two-level deduplication, life cycle and outbox texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.operators import metrics as m
from hostvigil.operators.lookups import recommendation_lookup
from hostvigil.operators.ordered import CHUNK_SECONDS, cooldown, with_next
from hostvigil.session import materialize

COOLDOWN_SECONDS = 900

# Advice of the alert kinds that are not about a label.
DDOS_ADVICE = "Investigate traffic volume, review top source IP address, and apply firewall/rate-limiting rules if appropriate."
RESOURCE_ADVICE = "Inspect high-resource processes using 'top' or 'ps aux', free up memory/disk, or scale host resources."
RECOVERY_ADVICE = "%s resource usage is back within normal operational limits."


def percent2(confidence: Column) -> Column:
    return F.format_string("%.2f", confidence * 100.0)


def email_source(alert_type: Column, source: Column, prediction: Column) -> Column:
    """Second-level key: label and source of an attack, one constant for floods, the monitor and metric of a resource."""
    return (
        F.when(alert_type == "SECURITY_ATTACK", F.concat(prediction, F.lit(":"), source))
        .when(alert_type == "DDOS_DETECTED", F.lit("DDoSDetector"))
        .otherwise(F.concat(F.lit("ResourceMonitor ("), F.element_at(F.split(source, ":"), -1), F.lit(")")))
    )


def email_dedup(alerts: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that become mail: a second cooldown per (hostname, alert_type, email_key); every RECOVERY passes."""
    recovery = F.col("alert_type") == "RECOVERY"
    return cooldown(alerts.where(~recovery), ["hostname", "alert_type", "email_key"], seconds).unionByName(alerts.where(recovery))


def passing(incidents: DataFrame) -> DataFrame:
    """Incidents that may be dispatched: HIGH or CRITICAL, and confident enough."""
    return incidents.where(d.dispatchable(F.col("risk"), F.col("confidence")))


def security_alerts(incidents: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """Alert rows of dispatchable incidents, one per label and source within the cooldown."""
    return attack_rows(cooldown(passing(incidents), ["hostname", "prediction", "source_log"], seconds))


def attack_rows(sent: DataFrame) -> DataFrame:
    """The ``alerts`` rows of incidents that are sent."""
    detail = F.struct("prediction", F.round(F.col("confidence") * 100.0, 2).alias("confidence_percent"), "risk", "raw_log")
    return sent.select(
        "seq",
        "ts",
        "hostname",
        F.lit("SECURITY_ATTACK").alias("alert_type"),
        F.col("risk").alias("severity"),
        F.concat(
            F.lit("Security threat '"), "prediction", F.lit("' detected with "), percent2(F.col("confidence")),
            F.lit("% confidence in '"), "source_log", F.lit("'."),
        ).alias("description"),
        F.col("source_log").alias("source"),
        F.to_json(detail).alias("metrics"),
        F.lit("ACTIVE").alias("status"),
        "prediction",
        "confidence",
        "raw_log",
    )


def ddos_events(reports: DataFrame, seconds: float, window_seconds: int) -> DataFrame:
    """Anomalous windows that pass the cooldown of their top IP, with every column of both output tables."""
    return flood_rows(cooldown(reports.where("is_anomaly"), ["hostname", "top_ip"], seconds), window_seconds)


def flood_rows(kept: DataFrame, window_seconds: int) -> DataFrame:
    """The rows of windows that are reported, with every column of both output tables."""
    detail = F.struct(
        "hostname", F.lit(window_seconds).alias("window_seconds"), F.col("total_requests").alias("total_requests_in_window"),
        "requests_per_second", "requests_per_minute", F.col("unique_ips").alias("unique_ips_count"), "top_ip", "top_ip_requests",
        "top_endpoint", "top_endpoint_requests", "patterns_detected", "risk_level", "is_anomaly",
    )
    return kept.select(
        "seq",
        "ts",
        "hostname",
        F.array_join("patterns_detected", "; ").alias("pattern_type"),
        F.col("total_requests").alias("requests_count"),
        F.lit(window_seconds).cast("long").alias("window_seconds"),
        "top_ip",
        "top_endpoint",
        "risk_level",
        F.to_json(detail).alias("metrics_json"),
        F.concat(
            F.lit("Possible DDoS Attack detected: "), F.array_join("patterns_detected", ", "), F.lit(". Total requests: "),
            F.col("total_requests").cast("string"), F.lit(f" in {window_seconds}s."),
        ).alias("description"),
    )


def ddos_alerts(events: DataFrame) -> DataFrame:
    """The ``alerts`` rows that belong to ``ddos_events`` rows."""
    return events.select(
        "seq",
        "ts",
        "hostname",
        F.lit("DDOS_DETECTED").alias("alert_type"),
        F.col("risk_level").alias("severity"),
        "description",
        F.lit("DDoSDetector").alias("source"),
        F.col("metrics_json").alias("metrics"),
        F.lit("ACTIVE").alias("status"),
    )


def resolve_alerts(alerts: DataFrame, recoveries: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Add status and resolved_at: an alert is closed by the first later recovery of its host and metric."""
    marks = recoveries.select("hostname", "metric", "ts", "seq", F.col("ts").alias("_recovered"))
    both = alerts.withColumn("_alert", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    seen = with_next(both, ["hostname", "metric"], "_recovered", "resolved_at", chunk_seconds).where("_alert")
    status = F.when(F.col("resolved_at").isNull(), "ACTIVE").otherwise("RESOLVED")
    return seen.select(*alerts.columns, status.alias("status"), "resolved_at")


def alert_lifecycle(samples: DataFrame, seconds: float = COOLDOWN_SECONDS, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Resource alerts with their resolution, and recovery rows (stored resolved, without a time)."""
    changes = materialize(m.transitions(samples, chunk_seconds), "transitions")
    back = changes.where("event_type = 'RECOVERY'")
    raised = materialize(cooldown(m.alert_candidates(changes), ["hostname", "alert_type", "metric"], seconds), "raised")
    resolved = resolve_alerts(raised, back, chunk_seconds)
    recovered = back.select(
        "seq",
        "ts",
        "hostname",
        "metric",
        F.lit("RECOVERY").alias("alert_type"),
        F.lit("NORMAL").alias("severity"),
        "current_value",
        "threshold",
        F.concat(F.lit("ResourceMonitor:"), "metric").alias("source"),
        F.lit("RESOLVED").alias("status"),
        F.lit(None).cast(resolved.schema["resolved_at"].dataType).alias("resolved_at"),
    )
    return with_resource_text(resolved.unionByName(recovered))


def with_resource_text(rows: DataFrame) -> DataFrame:
    """Add description and metrics (JSON) of resource alerts and recoveries."""
    text = resource_description(F.col("alert_type"), F.col("metric"), F.col("severity"), F.col("current_value"), F.col("threshold"))
    return rows.withColumns({"description": text, "metrics": F.to_json(F.create_map(F.concat(F.lower("metric"), F.lit("_percent")), F.col("current_value")))})


def resource_description(alert_type: Column, metric: Column, severity: Column, current: Column, threshold: Column) -> Column:
    value = F.format_string("%.1f", current)
    raised = F.concat(metric, F.lit(" usage reached "), severity, F.lit(" state: "), value, F.lit("% (Threshold: "), F.format_string("%.1f", threshold), F.lit("%)."))
    return F.when(alert_type == "RECOVERY", F.concat(metric, F.lit(" usage returned to NORMAL state: "), value, F.lit("%."))).otherwise(raised)


def metrics_lines(metrics: Column) -> Column:
    """A string map as ``key: value`` lines."""
    return F.array_join(F.transform(F.map_entries(metrics), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def notice(facts: dict[str, Column], blocks: dict[str, Column]) -> Column:
    """A plain-text body: one ``label = value`` line per fact that is set, then each block under its label, indented."""
    lines = [F.concat(F.lit(f"{label} = "), value.cast("string")) for label, value in facts.items()]
    parts = [F.concat(F.lit(f"{label}\n  "), F.replace(value, F.lit("\n"), F.lit("\n  "))) for label, value in blocks.items()]
    return F.concat_ws("\n\n", F.concat_ws("\n", *lines), *parts)


def event_outbox(alerts: DataFrame) -> DataFrame:
    """Subject and body of resource, flood and recovery notices; needs description, source, metrics map, recommendation."""
    icon = F.when(F.col("alert_type") == "RECOVERY", "✅").otherwise("🚨")
    facts = {"kind": F.col("alert_type"), "severity": F.col("severity"), "host": F.col("hostname"), "raised by": F.col("source"), "time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    blocks = {"what happened": F.col("description"), "figures": metrics_lines(F.col("metrics")), "what to do": F.col("recommendation")}
    subject = F.concat(icon, F.lit(" ["), "severity", F.lit("] "), "alert_type", F.lit(" Notification - "), "hostname")
    return alerts.select("seq", "ts", "hostname", "alert_type", subject.alias("subject"), "description", notice(facts, blocks).alias("body"))


def attack_outbox(alerts: DataFrame) -> DataFrame:
    """Subject and body of security alerts."""
    facts = {
        "label": F.col("prediction"), "risk": F.col("severity"), "confidence": F.concat(percent2(F.col("confidence")), F.lit("%")),
        "host": F.col("hostname"), "read from": F.col("source"), "time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    }
    blocks = {"what happened": F.col("description"), "line": F.col("raw_log"), "what to do": F.col("recommendation")}
    subject = F.concat(F.lit("🚨 ["), "severity", F.lit("] Threat Alert: "), "prediction", F.lit(" on "), "hostname")
    advised = recommendation_lookup(alerts)
    return advised.select("seq", "ts", "hostname", "alert_type", subject.alias("subject"), "description", notice(facts, blocks).alias("body"))


def resource_outbox(lifecycle: DataFrame) -> DataFrame:
    """Notices of the alert life cycle."""
    advice = F.when(F.col("alert_type") == "RECOVERY", F.format_string(RECOVERY_ADVICE, "metric")).otherwise(RESOURCE_ADVICE)
    value = F.create_map(F.concat(F.lower("metric"), F.lit("_percent")), F.format_string("%.1f", "current_value"))
    return event_outbox(
        lifecycle.withColumns({"recommendation": advice, "metrics": value, "source": F.concat(F.lit("ResourceMonitor ("), "metric", F.lit(")"))})
    )


# The figures of a flood report in the order of its JSON form.
FLOOD_FIGURES = [
    "hostname", "window_seconds", "total_requests_in_window", "requests_per_second", "requests_per_minute", "unique_ips_count", "top_ip", "top_ip_requests",
    "top_endpoint", "top_endpoint_requests", "patterns_detected", "risk_level", "is_anomaly",
]


def flood_outbox(events: DataFrame) -> DataFrame:
    """Notices of flood events, with every figure of the report."""
    pairs = F.create_map(*[x for name in FLOOD_FIGURES for x in (F.lit(name), F.coalesce(F.get_json_object("metrics_json", f"$.{name}"), F.lit("")))])
    fields = {"alert_type": F.lit("DDOS_DETECTED"), "severity": F.col("risk_level"), "source": F.lit("DDoSDetector"), "metrics": pairs, "recommendation": F.lit(DDOS_ADVICE)}
    return event_outbox(events.withColumns(fields))
