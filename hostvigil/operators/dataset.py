"""Labelled text: union, deduplication, cleaning, shuffling, statistics, splitting, label ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostvigil.functions.text import is_blank
from hostvigil.operators.lookups import tag_label_type
from hostvigil.operators.ordered import RANK_BUCKETS, with_rank


def clean_dataset_text(rows: DataFrame) -> DataFrame:
    """Drop rows without text or label, and repair invalid UTF-8."""
    return rows.where(F.col("label").isNotNull() & ~is_blank(F.col("text"))).withColumn("text", F.make_valid_utf8("text"))


def dedup_keep_first(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first row of every text. Copies merge before the shuffle, so a text copied very often costs no more."""
    order = order or ["ord"]
    rest = [c for c in rows.columns if c != "text" and c not in order]
    first = rows.groupBy("text").agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*[F.col("text") if c == "text" else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def union_datasets(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def order_key(seed: int, ord_col: str = "ord") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ord_col).cast("string")))


def shuffle_rows(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order that does not depend on partitioning; the order key is kept."""
    return rows.withColumn("order_key", order_key(seed)).orderBy("order_key")


def label_distribution(rows: DataFrame) -> DataFrame:
    """Count and percentage per label; the total comes from the per-label counts, one row per class."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 2)
    return counts.withColumn("percentage", share)


def dataset_statistics(rows: DataFrame) -> DataFrame:
    return tag_label_type(label_distribution(rows))


def server_web_ratio(rows: DataFrame, label: str = "label") -> DataFrame:
    """Server and web sample counts with percentages."""
    by_label = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = tag_label_type(by_label).agg(
        F.coalesce(F.sum(F.when(F.col("type") == "Server", F.col("n"))), F.lit(0)).alias("server_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("_all")
    )
    server_pct = F.round(F.try_divide(F.col("server_count") * F.lit(100.0), F.col("_all")), 2)
    return totals.select(
        "server_count", (F.col("_all") - F.col("server_count")).alias("web_count"), server_pct.alias("server_pct"), F.round(100.0 - server_pct, 2).alias("web_pct")
    )


def dataset_summary(rows: DataFrame) -> DataFrame:
    by_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return by_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), F.count("label").alias("total_classes"))


def build_dataset(existing: DataFrame, new: DataFrame, seed: int = 42) -> DataFrame:
    """Union, first copy of each text, cleaning, seeded order."""
    return shuffle_rows(clean_dataset_text(dedup_keep_first(union_datasets(existing, new))), seed)


def stratified_split(rows: DataFrame, seed: int = 42, train: int = 8, validation: int = 1) -> DataFrame:
    """Add split: tenths of each label in a seeded order go to train, validation and test.

    A label is ranked bucket by bucket (the leading digits of its order key), so no class sits in one task.
    """
    keyed = rows.withColumn("_key", order_key(seed))
    bucket = F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") / F.lit(65_536 // RANK_BUCKETS)).cast("int")
    ranked = with_rank(keyed, ["label"], "_key", bucket, "_rank")
    at = (F.col("_rank") - 1) * 10
    split = F.when(at < F.col("_rank_of") * train, "train").when(at < F.col("_rank_of") * (train + validation), "validation").otherwise("test")
    return ranked.select(*rows.columns, split.alias("split"))


def label_ids(rows: DataFrame) -> DataFrame:
    """Sorted labels with ids from 0. Only the distinct labels, a small set, share one partition."""
    return rows.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))


def label_encode(rows: DataFrame) -> DataFrame:
    # The ids, one row a class, go to the rows: dealt by label, all rows of a class would meet in one task.
    return rows.join(F.broadcast(label_ids(rows.where(F.col("label").isNotNull()))), "label", "left").select(*rows.columns, "label_id")


def retrain_merge(main: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Main rows and approved reviewed rows; the main row wins where texts are equal. Labels are encoded anew."""
    old = main.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select(F.lit(0).alias("origin"), "ord", "text", "label")
    fresh = reviewed.where((F.col("status") == "approved") & F.col("text").isNotNull() & F.col("label").isNotNull())
    merged = dedup_keep_first(old.unionByName(fresh.select(F.lit(1).alias("origin"), "ord", "text", "label")), ["origin", "ord"])
    return label_encode(merged)
