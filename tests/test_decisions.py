import pytest
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.functions import dims
from hostvigil.operators import incidents, lookups


def decide(spark, label, confidence, base, **options):
    frame = spark.createDataFrame([(label, confidence, base)], "label STRING, c DOUBLE, base STRING")
    return d.with_decision(frame, "label", "c", "base", **options).first()


@pytest.mark.parametrize(
    ("label", "confidence", "base", "decision", "severity", "email"),
    [
        ("Benign", 0.95, "SAFE", "IGNORE", "SAFE", False),
        ("Insecure_Deserialization", 0.0974, "CRITICAL", "IGNORE", "SAFE", False),
        ("XSS", 0.35, "HIGH", "IGNORE", "SAFE", False),
        ("XSS", 0.40, "HIGH", "LOG_ONLY", "UNKNOWN", False),
        ("SQL_Injection", 0.55, "HIGH", "LOG_ONLY", "UNKNOWN", False),
        ("XSS", 0.699, "HIGH", "LOG_ONLY", "UNKNOWN", False),
        ("XSS", 0.70, "HIGH", "ALERT", "HIGH", True),
        ("SSH_BruteForce", 0.789, "HIGH", "ALERT", "HIGH", True),
        ("ReverseShell", 0.75, "CRITICAL", "ALERT", "CRITICAL", True),
        ("System_Enumeration", 0.75, "LOW", "ALERT", "MEDIUM", False),
        ("System_Enumeration", 0.85, "LOW", "ALERT", "HIGH", True),
        ("PortScanning", 0.90, "MEDIUM", "ALERT", "HIGH", True),
        ("PortScanning", 0.95, "MEDIUM", "ALERT", "HIGH", True),
        ("XSS", 0.95, "HIGH", "ALERT", "CRITICAL", True),
        ("ReverseShell", 0.96, "CRITICAL", "ALERT", "CRITICAL", True),
        ("XSS", 97.4, "HIGH", "ALERT", "CRITICAL", True),
    ],
)
def test_decision_table(spark, label, confidence, base, decision, severity, email):
    row = decide(spark, label, confidence, base)
    assert (row.decision, row.severity, row.email_required, row.is_attack) == (decision, severity, email, decision == "ALERT")


def test_reasons(spark):
    assert decide(spark, "XSS", 0.55, "HIGH").reason == "Confidence (55.0%) below threshold (70%) — logged for review only"
    assert decide(spark, "XSS", 0.9, "HIGH").reason == "High confidence attack (90.0%) — category: XSS"


def test_passthrough(spark):
    row = decide(spark, "XSS", 0.1, "HIGH", enabled=False)
    assert (row.decision, row.severity, row.email_required) == ("ALERT", "HIGH", True)


@pytest.mark.parametrize(("given", "expected"), [(0.974, 0.974), (97.4, 0.974), (9.74, 0.0974), (1.0, 1.0), (-0.5, 0.0), (250.0, 2.5)])
def test_confidence(spark, given, expected):
    assert spark.range(1).select(d.normalize_confidence(F.lit(given))).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(
    ("label", "confidence", "text", "risk"),
    [
        ("Insecure_Deserialization", 0.0974, "", "SAFE"), ("SSH_BruteForce", 0.55, "", "SAFE"), ("ReverseShell", 0.30, "", "SAFE"),
        ("SQL_Injection", 0.92, "", "HIGH"), ("SQL_Injection", 0.92, "cat /ETC/shadow", "CRITICAL"), ("SQL_Injection", 0.89, "cat /etc/shadow", "HIGH"), ("SQL_Injection", 0.95, "cat /etc/pas\u017f\u017fwd", "HIGH"),
        ("ReverseShell", 0.95, None, "CRITICAL"), ("PortScanning", 0.80, "root", "MEDIUM"), ("Benign", 0.95, "root", "SAFE"), ("Benign", 0.50, "", "LOW"), ("RCE", 0.99, "root", "MEDIUM"),
    ],
)
def test_risk(spark, label, confidence, text, risk):
    frame = spark.createDataFrame([(label, confidence, text)], "prediction STRING, confidence DOUBLE, clean_text STRING")
    assert incidents.decide(frame).first().risk_level == risk


@pytest.mark.parametrize(
    ("label", "confidence", "weight", "expected"),
    [("RCE", 1.0, 1.0, (99.99, "CRITICAL")), ("Benign", 0.9, 0.0, (1.5, "SAFE")), ("XSS", 0.3, 0.8, (45.0, "MEDIUM")), ("Zero_Day", 0.1, 0.5, (22.0, "LOW"))],
)
def test_weighted_risk(spark, label, confidence, weight, expected):
    row = spark.range(1).select(d.weighted_risk(F.lit(label), F.lit(confidence), F.lit(weight)).alias("r")).first().r
    assert (row.risk_pct, row.risk_level) == expected


def test_final_severity(spark):
    cases = [("HIGH", "CRITICAL", "CRITICAL"), ("HIGH", "SAFE", "HIGH"), ("UNKNOWN", "LOW", "UNKNOWN"), ("MEDIUM", "odd", "MEDIUM")]
    frame = spark.createDataFrame(cases, "a STRING, b STRING, c STRING")
    assert frame.where(d.final_severity(F.col("a"), F.col("b")) != F.col("c")).count() == 0


def test_lookups_and_expression_agree(spark):
    frame = spark.createDataFrame([(x,) for x in [*dims.LABELS, "Zero_Day", None]], "prediction STRING")
    rows = lookups.severity_lookup(frame).withColumn("expr", d.base_severity(F.col("prediction"))).collect()
    assert len(rows) == 50 and all(r.base_severity == r.expr for r in rows)
    found = {r.prediction: r.recommendation for r in lookups.recommendation_lookup(frame).collect()}
    assert found["XSS"] == dims.ADVICE["XSS"] and found["RCE"] == found[None] == dims.DEFAULT_ADVICE
    assert {r.prediction: r.weight for r in lookups.weight_lookup(frame).collect()}["Zero_Day"] == 0.5


def test_statistics_on_no_rows(spark):
    none = spark.createDataFrame([], "ts TIMESTAMP_NTZ, risk STRING, prediction STRING")
    as_of = F.lit("2024-01-02").cast("timestamp_ntz")
    assert tuple(incidents.statistics(none, none, none, as_of).first()) == (0, 0, 0, 0)
    assert tuple(incidents.risk_breakdown(none).first()) == (0,) * 5


def test_recent_incidents_filters_by_known_levels_only(spark):
    rows = [(i, i, r) for i, r in enumerate(["SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL"])]
    frame = spark.createDataFrame(rows, "seq INT, ts INT, risk STRING")
    assert [r.risk for r in incidents.recent_incidents(frame, 50, "HIGH").collect()] == ["CRITICAL", "HIGH"]
    assert incidents.recent_incidents(frame, 50, "ODD").count() == 5
    assert [r.seq for r in incidents.recent_incidents(frame, 2).collect()] == [4, 3]
