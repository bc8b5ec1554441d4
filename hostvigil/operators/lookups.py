"""Label lookups: left joins with broadcast dimension tables of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import dims


def _lookup(frame: DataFrame, dim: DataFrame, label: str, value: str, default, out: str) -> DataFrame:
    known = F.broadcast(dim.select(F.col("label").alias("_label"), F.col(value).alias("_value")))
    return frame.join(known, F.col(label) == F.col("_label"), "left").select(
        *[frame[c] for c in frame.columns], F.coalesce(F.col("_value"), F.lit(default)).alias(out)
    )


def severity_lookup(frame: DataFrame, label: str = "prediction") -> DataFrame:
    return _lookup(frame, dims.severity_dim(frame.sparkSession), label, "severity", dims.DEFAULT_SEVERITY, "base_severity")


def severity_lookup_alt(frame: DataFrame, label: str = "prediction") -> DataFrame:
    return _lookup(frame, dims.severity_dim_alt(frame.sparkSession), label, "severity", dims.DEFAULT_SEVERITY, "base_severity")


def weight_lookup(frame: DataFrame, label: str = "prediction") -> DataFrame:
    return _lookup(frame, dims.weight_dim(frame.sparkSession), label, "weight", dims.DEFAULT_WEIGHT, "weight")


def recommendation_lookup(frame: DataFrame, label: str = "prediction") -> DataFrame:
    return _lookup(frame, dims.advice_dim(frame.sparkSession), label, "recommendation", dims.DEFAULT_ADVICE, "recommendation")


def tag_label_type(frame: DataFrame, label: str = "label") -> DataFrame:
    """Add type: Server for the labels of the server set, Web for every other one."""
    server = dims.server_dim(frame.sparkSession).select("label", F.lit("Server").alias("type"))
    return _lookup(frame, server, label, "type", "Web", "type")


def new_labels(reviewed: DataFrame, known: DataFrame) -> DataFrame:
    """Approved labels that are not among the known ones."""
    approved = reviewed.where(F.col("status") == "approved").select(F.col("reviewed_label").alias("label")).distinct()
    return approved.join(known.select("label"), "label", "left_anti")
