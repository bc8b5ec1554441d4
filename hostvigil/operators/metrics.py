"""Host metrics: threshold states, transitions, recoveries, resource alerts and health rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import dims
from hostvigil.functions.decisions import metric_state
from hostvigil.operators.ordered import CHUNK_SECONDS, cooldown, with_previous
from hostvigil.session import materialize

KEYS = ["hostname", "metric"]


def metric_states(samples: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Add warning, critical and state; samples of a metric without limits are dropped."""
    limits = F.broadcast(limits if limits is not None else dims.metric_dim(samples.sparkSession))
    return samples.join(limits, "metric").select(
        *[samples[c] for c in samples.columns],
        "warning",
        "critical",
        metric_state(F.col("current_value"), F.col("warning"), F.col("critical")).alias("state"),
    )


def overall_severity(samples: DataFrame, tick: str = "1 hour") -> DataFrame:
    """Worst state of a host's metrics per tick."""
    rank = F.when(F.col("state") == "CRITICAL", 2).when(F.col("state") == "WARNING", 1).otherwise(0)
    worst = metric_states(samples).groupBy("hostname", tick_start(tick).alias("tick")).agg(F.max(rank).alias("_worst"))
    return worst.select("hostname", "tick", F.get(F.array(F.lit("NORMAL"), F.lit("WARNING"), F.lit("CRITICAL")), "_worst").alias("overall_severity"))


def tick_start(tick: str, ts: str = "ts") -> Column:
    return F.window(ts, tick)["start"]


def transitions(samples: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Samples whose state differs from the one before (NORMAL at first), with event type and threshold crossed."""
    states = metric_states(samples)
    changed = with_previous(states, KEYS, "state", "old_state", "NORMAL", chunk_seconds).where("state <> old_state")
    state = F.col("state")
    return changed.select(
        "seq",
        "ts",
        *KEYS,
        "current_value",
        "old_state",
        state.alias("new_state"),
        F.when(state == "NORMAL", "RECOVERY").otherwise(F.concat("metric", F.lit("_"), state)).alias("event_type"),
        F.when(state == "CRITICAL", F.col("critical")).otherwise(F.col("warning")).alias("threshold"),
    )


def recoveries(samples: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    return transitions(samples, chunk_seconds).where("event_type = 'RECOVERY'")


def alert_candidates(changes: DataFrame) -> DataFrame:
    """Warning and critical transitions as resource alerts, before the cooldown."""
    suffix = F.when(F.col("new_state") == "WARNING", "_HIGH").otherwise("_CRITICAL")
    return changes.where("new_state <> 'NORMAL'").select(
        "seq",
        "ts",
        *KEYS,
        F.concat("metric", suffix).alias("alert_type"),
        F.col("new_state").alias("severity"),
        "current_value",
        "threshold",
        F.concat(F.lit("ResourceMonitor:"), "metric").alias("source"),
    )


def resource_alerts(samples: DataFrame, seconds: float, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Resource alerts that pass the cooldown of their type and metric."""
    changes = materialize(transitions(samples, chunk_seconds), "transitions")
    return cooldown(alert_candidates(changes), ["hostname", "alert_type", "metric"], seconds)


def health_snapshot(samples: DataFrame, tick: str = "1 hour") -> DataFrame:
    """One row per host and tick with the latest CPU, RAM and DISK values."""
    latest = F.max_by("current_value", F.struct("ts", "seq"))
    by_metric = samples.groupBy("hostname", tick_start(tick).alias("tick"), "metric").agg(latest.alias("value"))
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m.lower()}_percent") for m in dims.METRIC_LIMITS]
    return by_metric.groupBy("hostname", "tick").agg(*columns)
