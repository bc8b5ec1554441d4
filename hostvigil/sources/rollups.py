"""Hourly partial counts next to the incident tables: summaries read them instead of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from hostvigil.functions.dims import RISK_LEVELS
from hostvigil.operators.incidents import within
from hostvigil.sources import files

# What is counted by hour, for each table.
GROUPS = {"attack_logs": ("risk", "prediction"), "ddos_events": ("risk_level",), "resource_alerts": ("severity",)}
_NAMES = "table_name STRING, hour TIMESTAMP_NTZ, level STRING, kind STRING, n BIGINT, batch BIGINT"


def append_counted(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Append a batch to an incident table, and its counts by hour below the same batch id.

    Both are written with overwrite under the id: a batch that runs again replaces its rows and its counts.
    """
    files.append_table(rows, root, table, batch_id)
    level, *kind = GROUPS[table]
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    counts = rows.groupBy(hour, F.col(level).alias("level"), (F.col(kind[0]) if kind else F.lit(None).cast("string")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{root}/_hours/table_name={table}/batch={batch_id}")


def hours(spark: SparkSession, root: str, *tables: str) -> DataFrame:
    """(table_name, hour, level, kind, n), merged over all batches."""
    rows = spark.read.schema(_NAMES).parquet(f"{root}/_hours").where(F.col("table_name").isin(*(tables or GROUPS)))
    return rows.groupBy("table_name", "hour", "level", "kind").agg(F.sum("n").alias("n"))


def statistics(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """The four counts from hourly counts; of the incidents themselves only those of the hour in which the last day begins."""
    zero = F.lit(0).cast("long")
    counts = hours(spark, root)
    start = as_of - F.expr("INTERVAL 24 HOURS")
    whole = (F.col("table_name") == "attack_logs") & (F.col("hour") >= start)
    sums = [F.sum(F.when(F.col("table_name") == t, F.col("n"))) for t in GROUPS]
    totals = counts.agg(*[F.coalesce(s, zero).alias(n) for s, n in zip(sums, ("total_incidents", "total_ddos_events", "total_resource_alerts"))], F.coalesce(F.sum(F.when(whole, F.col("n"))), zero).alias("_day"))
    first = F.date_trunc("hour", start.cast("timestamp")).cast("timestamp_ntz")
    edge = files.read_table(spark, root, "attack_logs").where((F.col("dt") >= F.to_date(start)) & (F.col("dt") <= F.to_date(start)) & within(as_of, 24, "timestamp"))
    edge = edge.where((first < start) & (F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz") == first))
    both = totals.crossJoin(edge.agg(F.count(F.lit(1)).alias("_edge")))  # of two single rows
    return both.select("total_incidents", "total_ddos_events", "total_resource_alerts", (F.col("_day") + F.col("_edge")).alias("last_24h_incidents"))


def risk_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Incidents per risk level, zero where there are none."""
    counts = hours(spark, root, "attack_logs")
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0).cast("long")).alias(level) for level in reversed(RISK_LEVELS)])


def top_attack_types(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """The commonest labels other than Benign."""
    found = hours(spark, root, "attack_logs").where("kind <> 'Benign'").groupBy(F.col("kind").alias("prediction")).agg(F.sum("n").alias("cnt"))
    return found.orderBy(F.desc("cnt"), "prediction").limit(k)


def hourly_report(spark: SparkSession, root: str) -> DataFrame:
    """Totals and CRITICAL, HIGH and MEDIUM counts of each hour, with the running total over the hours."""
    level = lambda r: F.coalesce(F.sum(F.when(F.col("level") == r, F.col("n"))), F.lit(0).cast("long")).alias(r.lower())
    rows = hours(spark, root, "attack_logs").groupBy("hour").agg(F.sum("n").alias("total"), *[level(r) for r in ("CRITICAL", "HIGH", "MEDIUM")])
    return rows.withColumn("running_total", F.sum("total").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))
