"""Review queue: unknown findings, reviewers' verdicts, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d


def flag_unknown(scored: DataFrame, exclude_benign: bool = True) -> DataFrame:
    return scored.withColumns(
        {
            "is_malicious": F.col("prediction") != "Benign",
            "is_unknown": d.is_unknown(F.col("prediction"), F.col("confidence"), exclude_benign),
        }
    )


def queue_unknown(scored: DataFrame, exclude_benign: bool = True) -> DataFrame:
    """Unknown findings as pending queue rows."""
    return scored.where(d.is_unknown(F.col("prediction"), F.col("confidence"), exclude_benign)).select(
        F.col("seq").cast("string").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("clean_text").alias("raw_log"),
        F.col("prediction").alias("predicted_label"),
        F.round("confidence", 4).alias("confidence"),
        F.col("source_log").alias("log_source"),
        F.lit("pending").alias("status"),
        F.lit("").alias("reviewed_label"),
    )


def apply_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """The queue after the latest verdict per id. ``reviews`` is (id, review_seq, action, label).

    A rejection leaves an earlier label as it is, so the label is that of the latest approval.
    """
    approve = F.col("action") == "approve"
    latest = reviews.groupBy("id").agg(
        F.max_by(F.when(approve, "approved").otherwise("rejected"), "review_seq").alias("_status"),
        F.max_by(F.col("label"), F.when(approve, F.col("review_seq"))).alias("_label"),
    )
    return queue.join(latest, "id", "left").select(
        *[c for c in queue.columns if c not in ("status", "reviewed_label")],
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_label", "reviewed_label").alias("reviewed_label"),
    )


def pending_reviews(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")


def export_approved(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'approved'").select(
        F.col("raw_log").alias("text"), F.col("reviewed_label").alias("label"), "confidence", "log_source", "timestamp", "status"
    )


def review_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")])


def weekly_report(queue: DataFrame, as_of: Column) -> DataFrame:
    """Last seven days as (section, key, n): totals by status, ten top labels, five top sources."""
    week = queue.where(F.col("timestamp") >= as_of - F.expr("INTERVAL 7 DAYS"))
    # One pass counts every combination; the sections then work on that small table.
    cube = week.groupBy("status", "predicted_label", "log_source").agg(F.count(F.lit(1)).alias("n"))
    totals = cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("pending", "approved", "rejected")],
    )
    rows = totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in totals.columns])))
    for section, column, k in (("label", "predicted_label", 10), ("source", "log_source", 5)):
        top = cube.groupBy(F.col(column).alias("key")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(k)
        rows = rows.unionByName(top.withColumn("section", F.lit(section)))
    return rows
