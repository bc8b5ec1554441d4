"""Incident tables: routing of scored lines, read queries, statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.functions.dims import RISK_LEVELS
from hostvigil.operators.ordered import evaluate_once


def decide(scored: DataFrame, enabled: bool = True) -> DataFrame:
    """Add the decision's fields and risk_level to rows of prediction, confidence and clean_text."""
    based = scored.withColumn("_base", d.base_severity(F.col("prediction")))
    decided = d.with_decision(based, "prediction", "confidence", "_base", enabled)
    return d.with_risk_level(decided, "prediction", "confidence", "_base", "clean_text").drop("_base")


def incident_rows(decided: DataFrame) -> DataFrame:
    """Rows of the incident table: LOG_ONLY as safe and low-confidence, ALERT at the higher of both severities."""
    alert = F.col("decision") == "ALERT"
    rows = evaluate_once(decided, "decision", "severity", "risk_level")
    return rows.where(F.col("decision").isin("LOG_ONLY", "ALERT")).select(
        "*",
        F.when(alert, d.final_severity(F.col("severity"), F.col("risk_level"))).otherwise("SAFE").alias("risk"),
        F.when(alert, "new").otherwise("low_confidence").alias("status"),
    )


def at_least(min_risk: str | None) -> Column | None:
    """Whether the risk is at or above a level; None for an unknown level."""
    return F.col("risk").isin(RISK_LEVELS[RISK_LEVELS.index(min_risk) :]) if min_risk in RISK_LEVELS else None


def recent_incidents(incidents: DataFrame, limit: int = 50, min_risk: str | None = None) -> DataFrame:
    """Newest incidents at or above a risk; an unknown level filters nothing."""
    wanted = at_least(min_risk)
    return newest(incidents if wanted is None else incidents.where(wanted), limit)


def recent_decisions(decisions: DataFrame, limit: int = 50, decision: str | None = None) -> DataFrame:
    return newest(decisions.where(F.col("decision") == decision) if decision else decisions, limit)


def newest(frame: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = frame.orderBy(F.desc("ts"), F.desc("seq"))
    return ordered if limit is None else ordered.limit(limit)


def active_alerts(alerts: DataFrame) -> DataFrame:
    return newest(alerts.where("status = 'ACTIVE'"))


def surrogate_id(kind: str, *parts: str) -> Column:
    """A row id that needs no global order: 128 bits of the SHA-256 of what makes a row one of its kind.

    Rows of one host that share a sequence number, as alerts of several kinds do, need more ``parts``.
    """
    named = F.to_json(F.struct(F.lit(kind).alias("kind"), "hostname", "seq", *parts))
    return F.left(F.sha2(named, 256), F.lit(32))


def statistics(incidents: DataFrame, floods: DataFrame, resource_alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row: incidents, flood events, resource alerts, incidents of the last 24 hours."""
    zero = F.lit(0).cast("long")
    tables = (
        incidents.select(F.lit(1).alias("i"), zero.alias("f"), zero.alias("r"), within(as_of, 24).cast("long").alias("d"))
        .union(floods.select(zero, F.lit(1), zero, zero))
        .union(resource_alerts.select(zero, zero, F.lit(1), zero))
    )
    names = {"i": "total_incidents", "f": "total_ddos_events", "r": "total_resource_alerts", "d": "last_24h_incidents"}
    return tables.agg(*[F.coalesce(F.sum(c), zero).alias(n) for c, n in names.items()])


def within(as_of: Column, hours: int, ts: str = "ts") -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")


def risk_breakdown(incidents: DataFrame) -> DataFrame:
    """Incidents per risk level, zero where there are none."""
    return incidents.agg(*[F.count_if(F.col("risk") == level).alias(level) for level in reversed(RISK_LEVELS)])


def top_attack_types(incidents: DataFrame, k: int = 10) -> DataFrame:
    counted = incidents.where("prediction <> 'Benign'").groupBy("prediction").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.orderBy(F.desc("cnt"), "prediction").limit(k)


def last_24h(incidents: DataFrame, as_of: Column) -> DataFrame:
    return incidents.where(within(as_of, 24)).agg(F.count(F.lit(1)).alias("last_24h_incidents"))


def hourly_report(incidents: DataFrame) -> DataFrame:
    """Totals and CRITICAL, HIGH and MEDIUM counts of each hour, with the running total.

    The running sum is over one row per hour, so its single partition does not grow with the data.
    """
    hours = incidents.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("CRITICAL", "HIGH", "MEDIUM")]
    )
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.withColumn("running_total", F.sum("total").over(upto))


def counters() -> dict[str, Column]:
    """Processed lines, pre-filter outcomes and incidents, as aggregates over routed lines."""
    return {
        "processed": F.count(F.lit(1)),
        "benign_filtered": F.count_if(F.col("route") == "BENIGN"),
        "suspicious_overrides": F.count_if(F.col("pre_decision") == "SUSPICIOUS"),
        "passed_to_ai": F.count_if(F.col("pre_decision") == "PASS_TO_AI"),
        "incidents": F.count_if(F.col("route") == "ALERT"),
    }


def pipeline_counters(routed: DataFrame) -> DataFrame:
    """The counters of each host."""
    return routed.groupBy("hostname").agg(*[c.alias(k) for k, c in counters().items()])
