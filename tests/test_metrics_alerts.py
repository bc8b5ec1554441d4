from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.operators import alerts, metrics, traffic

START = datetime(2026, 1, 1)


def samples(spark, values, metric="CPU", host="vps", step=60):
    rows = [(i, START + timedelta(seconds=i * step), host, metric, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, metric STRING, current_value DOUBLE")


@pytest.mark.parametrize(("value", "state"), [(50, "NORMAL"), (80, "WARNING"), (85, "WARNING"), (95, "CRITICAL"), (97, "CRITICAL")])
def test_metric_state(spark, value, state):
    assert spark.range(1).select(d.metric_state(F.lit(float(value)), F.lit(80.0), F.lit(95.0))).first()[0] == state


@pytest.mark.parametrize("chunk", [60, 86_400])
def test_transitions(spark, chunk):
    rows = metrics.transitions(samples(spark, [10, 85, 86, 97, 85, 10, 10, 97]), chunk).orderBy("seq").collect()
    assert [(r.seq, r.event_type, r.old_state, r.threshold) for r in rows] == [
        (1, "CPU_WARNING", "NORMAL", 80.0), (3, "CPU_CRITICAL", "WARNING", 95.0), (4, "CPU_WARNING", "CRITICAL", 80.0), (5, "RECOVERY", "WARNING", 80.0), (7, "CPU_CRITICAL", "NORMAL", 95.0),
    ]


def test_critical_to_warning_raises_the_high_alert_and_recovery_closes_both(spark):
    rows = alerts.alert_lifecycle(samples(spark, [97, 85, 10, 97]), 900).orderBy("seq").collect()
    assert [(r.seq, r.alert_type, r.status, r.resolved_at) for r in rows] == [
        (0, "CPU_CRITICAL", "RESOLVED", START + timedelta(minutes=2)), (1, "CPU_HIGH", "RESOLVED", START + timedelta(minutes=2)), (2, "RECOVERY", "RESOLVED", None),
    ]


def test_recovery_is_emitted_although_its_alert_was_suppressed(spark):
    rows = alerts.alert_lifecycle(samples(spark, [85, 10, 85, 10]), 900).orderBy("seq").collect()
    assert [(r.seq, r.alert_type) for r in rows] == [(0, "CPU_HIGH"), (1, "RECOVERY"), (3, "RECOVERY")]


def test_open_alert_stays_active(spark):
    both = samples(spark, [85], "RAM").unionByName(samples(spark, [10, 85, 10], "DISK"))
    rows = {r.alert_type: r for r in alerts.alert_lifecycle(both, 900).where("alert_type <> 'RECOVERY'").collect()}
    assert rows["RAM_HIGH"].status == "ACTIVE" and rows["DISK_HIGH"].status == "RESOLVED"


def test_overall_severity_and_health(spark):
    both = samples(spark, [10, 85], "CPU").unionByName(samples(spark, [97], "RAM"))
    assert metrics.overall_severity(both).first().overall_severity == "CRITICAL"
    row = metrics.health_snapshot(both).first()
    assert (row.cpu_percent, row.ram_percent, row.disk_percent) == (85.0, 97.0, None)


def incident(seconds, label="XSS", risk="HIGH", confidence=0.9):
    return (int(seconds), START + timedelta(seconds=seconds), "vps", "/var/log/a", label, confidence, risk, "raw")


INCIDENT = "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, source_log STRING, prediction STRING, confidence DOUBLE, risk STRING, raw_log STRING"


def test_security_alerts_gate_and_cooldown(spark):
    rows = [incident(0), incident(1), incident(4), incident(5, risk="MEDIUM"), incident(6, "SSRF", confidence=0.5), incident(7, "RCE", "CRITICAL", 0.55)]
    out = alerts.security_alerts(spark.createDataFrame(rows, INCIDENT), 3).orderBy("seq").collect()
    assert [r.seq for r in out] == [0, 4, 7]
    assert out[0].description == "Security threat 'XSS' detected with 90.00% confidence in '/var/log/a'."
    assert out[0].metrics == '{"prediction":"XSS","confidence_percent":90.0,"risk":"HIGH","raw_log":"raw"}'


def test_email_dedup_keys(spark):
    rows = [(i, START + timedelta(seconds=i), "vps", t, k) for i, (t, k) in enumerate([("DDOS_DETECTED", "DDoSDetector"), ("DDOS_DETECTED", "DDoSDetector"), ("RECOVERY", "x"), ("RECOVERY", "x"), ("CPU_HIGH", "x")])]
    frame = spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, alert_type STRING, email_key STRING")
    assert sorted(r.seq for r in alerts.email_dedup(frame, 900).collect()) == [0, 2, 3, 4]


def test_email_source(spark):
    rows = [("SECURITY_ATTACK", "/a", "XSS", "XSS:/a"), ("DDOS_DETECTED", "DDoSDetector", None, "DDoSDetector"), ("CPU_HIGH", "ResourceMonitor:CPU", None, "ResourceMonitor (CPU)")]
    frame = spark.createDataFrame(rows, "t STRING, s STRING, p STRING, k STRING")
    assert frame.where(alerts.email_source(F.col("t"), F.col("s"), F.col("p")) == F.col("k")).count() == 3


def test_notices(spark):
    out = alerts.resource_outbox(alerts.alert_lifecycle(samples(spark, [97, 10]), 900)).orderBy("seq").collect()
    assert out[0].subject == "🚨 [CRITICAL] CPU_CRITICAL Notification - vps"
    assert out[0].description == "CPU usage reached CRITICAL state: 97.0% (Threshold: 95.0%)."
    assert "figures\n  cpu_percent: 97.0\n\nwhat to do\n  Inspect" in out[0].body
    assert out[1].subject == "✅ [NORMAL] RECOVERY Notification - vps" and out[1].description == "CPU usage returned to NORMAL state: 10.0%."
    mail = alerts.attack_outbox(alerts.security_alerts(spark.createDataFrame([incident(0)], INCIDENT), 3)).first()
    assert mail.subject == "🚨 [HIGH] Threat Alert: XSS on vps" and "confidence = 90.00%\nhost = vps" in mail.body and "Cross-site scripting" in mail.body


def test_flood_events_and_notices(spark):
    rows = [(i, START + timedelta(seconds=s), "vps", f"ip{i % 40}", "/x", "GET", 200) for i, s in enumerate([0] * 120 + [2000])]
    frame = spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, ip STRING, endpoint STRING, method STRING, status LONG")
    events = alerts.ddos_events(traffic.traffic_report(frame), 900, 10)
    first = events.orderBy("seq").first()
    assert (first.seq, first.pattern_type, first.top_ip) == (99, "Distributed DDoS (40 unique IPs sent 100 req/10s)", "ip0")
    assert first.description == "Possible DDoS Attack detected: Distributed DDoS (40 unique IPs sent 100 req/10s). Total requests: 100 in 10s."
    # No later request lifts another IP above the first one's three requests, so all windows share one key.
    assert events.count() == 1
    alert = alerts.ddos_alerts(events).orderBy("seq").first()
    assert (alert.source, alert.severity, alert.status) == ("DDoSDetector", "HIGH", "ACTIVE")
    mail = alerts.flood_outbox(events).orderBy("seq").first()
    assert mail.subject == "🚨 [HIGH] DDOS_DETECTED Notification - vps" and "top_ip: ip0" in mail.body
