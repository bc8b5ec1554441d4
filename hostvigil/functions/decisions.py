"""Confidence, decision and risk rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import dims

ALERT_CONFIDENCE = 0.70
UNKNOWN_CONFIDENCE = 0.60
DISPATCH_CONFIDENCE = 0.55

# A HIGH finding that names one of these is CRITICAL.
ESCALATION_PATHS = ["/etc/shadow", "/etc/passwd", "root", "/var/run/docker.sock"]

# Reason texts of the decision rules; %s is the label, %.1f the confidence in percent.
REASON_BENIGN = "AI model classified as Benign"
REASON_VERY_LOW = "Very low confidence (%.1f%%) — prediction unreliable, ignoring"
REASON_LOW = "Confidence (%.1f%%) below threshold (%.0f%%) — logged for review only"
REASON_MODERATE = "Moderate confidence attack (%.1f%%) — category: %s"
REASON_HIGH = "High confidence attack (%.1f%%) — category: %s"
REASON_VERY_HIGH = "Very high confidence attack (%.1f%%) — category: %s"
REASON_DISABLED = "Security Decision Engine disabled — passthrough mode"


def high_or_critical(severity: Column) -> Column:
    return severity.isin("HIGH", "CRITICAL")


def base_severity(label: Column) -> Column:
    """The severity dimension as an expression, for pipelines that need no join."""
    found = F.when(label == "Benign", "SAFE")
    for severity in ("CRITICAL", "HIGH", "LOW"):
        found = found.when(label.isin(dims.SEVERITY_LABELS[severity]), severity)
    return found.otherwise(dims.DEFAULT_SEVERITY)


def normalize_confidence(confidence: Column) -> Column:
    """Percentages become fractions; fractions are clamped to [0, 1]."""
    return F.when(confidence > 1.0, confidence / 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))


def decision_rule(label: Column, c: Column, threshold: float = ALERT_CONFIDENCE) -> Column:
    """Which rule decides: 0 benign, 1 very low, 2 low, 3 moderate, 4 high, 5 very high confidence."""
    return F.when(label == "Benign", 0).when(c < 0.40, 1).when(c < threshold, 2).when(c < 0.85, 3).when(c < 0.95, 4).otherwise(5)


def by_rule(rule: Column, *values: Column) -> Column:
    chain = F.when(rule == 0, values[0])
    for i, value in enumerate(values[1:-1], 1):
        chain = chain.when(rule == i, value)
    return chain.otherwise(values[-1])


def with_decision(
    frame: DataFrame, label: str, confidence: str, base: str, enabled: bool = True, threshold: float = ALERT_CONFIDENCE
) -> DataFrame:
    """Add decision, is_attack, norm_confidence, severity, reason and email_required.

    Each step is a column of its own, so that the plan evaluates it once however often it is used.
    """
    severity = F.col(base)
    steps = frame.withColumn("norm_confidence", normalize_confidence(F.col(confidence)))
    if not enabled:
        attack = F.col(label) != "Benign"
        return steps.withColumns(
            {
                "decision": F.when(attack, "ALERT").otherwise("IGNORE"),
                "is_attack": attack,
                "severity": F.when(attack, severity).otherwise("SAFE"),
                "reason": F.lit(REASON_DISABLED),
                "email_required": attack & high_or_critical(severity),
            }
        )
    rule, percent = F.col("_rule"), F.col("norm_confidence") * 100.0
    steps = steps.withColumn("_rule", decision_rule(F.col(label), F.col("norm_confidence"), threshold))
    safe = F.lit("SAFE")
    moderate = F.when(high_or_critical(severity), severity).otherwise("MEDIUM")
    high = F.when(severity == "CRITICAL", "CRITICAL").otherwise("HIGH")
    very_high = F.when(severity.isin("LOW", "MEDIUM"), "HIGH").otherwise("CRITICAL")
    attack_reason = [F.format_string(text, percent, F.col(label)) for text in (REASON_MODERATE, REASON_HIGH, REASON_VERY_HIGH)]
    return steps.withColumns(
        {
            "decision": F.when(rule <= 1, "IGNORE").when(rule == 2, "LOG_ONLY").otherwise("ALERT"),
            "is_attack": rule >= 3,
            "severity": by_rule(rule, safe, safe, F.lit("UNKNOWN"), moderate, high, very_high),
            "reason": by_rule(
                rule,
                F.lit(REASON_BENIGN),
                F.format_string(REASON_VERY_LOW, percent),
                F.format_string(REASON_LOW, percent, F.lit(threshold * 100.0)),
                *attack_reason,
            ),
            "email_required": (rule >= 4) | ((rule == 3) & high_or_critical(severity)),
        }
    ).drop("_rule")


def with_risk_level(frame: DataFrame, label: str, confidence: str, base: str, text: str, threshold: float = ALERT_CONFIDENCE) -> DataFrame:
    """Add risk_level: base severity, escalated by sensitive paths and gated by the confidence as given."""
    c, severity = F.col(confidence), F.col(base)
    # Only a confident HIGH finding can escalate, so only its text is lowered and searched.
    folded = frame.withColumn("_folded", F.when((severity == "HIGH") & (c >= 0.90), F.lower(F.coalesce(F.col(text), F.lit("")))))
    names_path = F.lit(False)
    for path in ESCALATION_PATHS:
        names_path = names_path | F.col("_folded").contains(path)
    risk = (
        F.when(F.col(label) == "Benign", F.when(c >= 0.70, "SAFE").otherwise("LOW"))
        .when(c < threshold, "SAFE")
        .when(F.col("_folded").isNotNull() & names_path, "CRITICAL")
        .otherwise(severity)
    )
    return folded.withColumn("risk_level", risk).drop("_folded")


def weighted_risk(label: Column, confidence: Column, weight: Column) -> Column:
    """Struct of risk_pct (two decimals) and risk_level from confidence and label weight."""
    attack = F.round(F.least((confidence * 0.70 + weight * 0.30) * 100.0, F.lit(99.99)), 2)
    level = F.when(attack >= 85.0, "CRITICAL").when(attack >= 65.0, "HIGH").when(attack >= 40.0, "MEDIUM").otherwise("LOW")
    benign = label == "Benign"
    return F.struct(
        F.when(benign, F.round((1.0 - confidence) * 15.0, 2)).otherwise(attack).alias("risk_pct"),
        F.when(benign, "SAFE").otherwise(level).alias("risk_level"),
    )


def severity_rank(severity: Column) -> Column:
    """Position in the severity order; an unknown name ranks as the lowest."""
    return F.greatest(F.array_position(F.lit(dims.SEVERITY_ORDER), severity) - 1, F.lit(0).cast("long"))


def final_severity(decided: Column, risk: Column) -> Column:
    """The higher of two severities; the decision's own on a tie."""
    return F.when(severity_rank(risk) > severity_rank(decided), risk).otherwise(decided)


def is_unknown(label: Column, confidence: Column, exclude_benign: bool = True, threshold: float = UNKNOWN_CONFIDENCE) -> Column:
    low = confidence < threshold
    return low & (label != "Benign") if exclude_benign else low


def dispatchable(risk: Column, confidence: Column, threshold: float = DISPATCH_CONFIDENCE) -> Column:
    """Only confident HIGH or CRITICAL findings become alerts."""
    return high_or_critical(risk) & (confidence >= threshold)


def metric_state(current: Column, warning: Column, critical: Column) -> Column:
    return F.when(current >= critical, "CRITICAL").when(current >= warning, "WARNING").otherwise("NORMAL")
