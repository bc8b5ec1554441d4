"""Datasets, review queues, predictions, label maps and the incident tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.functions.text import is_blank
from hostvigil.operators.incidents import surrogate_id

DATASET_SCHEMA = "text STRING, label STRING"
REVIEW_SCHEMA = (
    "id STRING, timestamp TIMESTAMP_NTZ, raw_log STRING, predicted_label STRING, confidence DOUBLE, "
    "log_source STRING, status STRING, reviewed_label STRING"
)

# Columns and types of the incident tables, besides id, seq and the partition date.
TABLES = {
    "attack_logs": "timestamp TIMESTAMP_NTZ, hostname STRING, source_log STRING, raw_log STRING, clean_text STRING, prediction STRING, confidence DOUBLE, risk STRING, status STRING",
    "alerts": "timestamp TIMESTAMP_NTZ, hostname STRING, alert_type STRING, severity STRING, description STRING, source STRING, metrics STRING, status STRING, resolved_at TIMESTAMP_NTZ",
    "resource_alerts": "timestamp TIMESTAMP_NTZ, hostname STRING, metric_name STRING, current_value DOUBLE, threshold_value DOUBLE, severity STRING, status STRING, resolved_at TIMESTAMP_NTZ",
    "ddos_events": "timestamp TIMESTAMP_NTZ, hostname STRING, pattern_type STRING, requests_count BIGINT, window_seconds BIGINT, top_ip STRING, top_endpoint STRING, risk_level STRING, metrics_json STRING",
    "system_health": "timestamp TIMESTAMP_NTZ, hostname STRING, cpu_percent DOUBLE, ram_percent DOUBLE, disk_percent DOUBLE, load_avg DOUBLE, agent_status STRING, heartbeat_time TIMESTAMP_NTZ",
    "security_decisions": "timestamp TIMESTAMP_NTZ, hostname STRING, source_log STRING, raw_log STRING, predicted_label STRING, confidence DOUBLE, decision STRING, severity STRING, reason STRING, email_sent INT",
}
# Columns that a writer may leave out: not known when the row is written.
OPTIONAL = {"resolved_at", "load_avg", "agent_status", "heartbeat_time", "status"}


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(f"id STRING, seq BIGINT, {TABLES[table]}, dt DATE")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").option("emptyValue", "").csv(path)


def read_labeled_dataset(spark: SparkSession, path: str, schema: str = DATASET_SCHEMA) -> DataFrame:
    """CSV rows that have a label and a text that is not blank."""
    rows = _csv(spark, path, schema)
    return rows.where(F.col("label").isNotNull() & ~is_blank(F.col("text")))


def read_review_queue(spark: SparkSession, path: str) -> DataFrame:
    """The review queue with ``id`` kept as text."""
    return _csv(spark, path, REVIEW_SCHEMA).na.fill("", ["reviewed_label"])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, as other CSV readers expect."""
    (
        rows.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    )


def write_dataset(rows: DataFrame, statistics: DataFrame, root: str) -> dict[str, str]:
    """The dataset as CSV and as JSON lines, and its statistics as CSV."""
    paths = {name: f"{root}/{name}" for name in ("csv", "json", "statistics")}
    write_csv(rows, paths["csv"])
    rows.write.json(paths["json"])
    write_csv(statistics, paths["statistics"])
    return paths


def write_predictions(scored: DataFrame, root: str) -> dict[str, str]:
    """All predictions, and the misclassified ones read back from them, so that scoring runs once."""
    paths = {name: f"{root}/{name}" for name in ("predictions", "misclassified")}
    scored.write.parquet(paths["predictions"])
    wrong = scored.sparkSession.read.parquet(paths["predictions"]).where("label <> predicted_label")
    wrong.write.parquet(paths["misclassified"])
    return paths


def table_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the shape of an incident table: id, its columns by type, partition date. A missing column is an error."""
    present = {"timestamp": F.col("ts"), **{c: F.col(c) for c in rows.columns if c != "ts"}}
    fields = table_schema(table).fields[2:-1]
    missing = [f.name for f in fields if f.name not in present and f.name not in OPTIONAL]
    if missing:
        raise ValueError(f"{table} needs {', '.join(missing)}")
    parts = [c for c in ("alert_type", "metric_name", "source") if c in rows.columns]
    columns = [present.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return rows.select(surrogate_id(table, *parts).alias("id"), F.col("seq").cast("long"), *columns, F.to_date("ts").alias("dt"))


def append_table(rows: DataFrame, root: str, table: str, batch_id: int | None = None) -> None:
    """Append to an incident table, partitioned by date.

    A streaming batch writes below its batch id with overwrite, so that a retried batch replaces its rows.
    """
    shaped = table_rows(rows, table)
    if batch_id is None:
        shaped.write.mode("append").partitionBy("dt").parquet(f"{root}/{table}")
    else:
        shaped.write.mode("overwrite").partitionBy("dt").parquet(f"{root}/{table}/batch={batch_id}")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """An incident table; ``security_events`` is the same rows as ``attack_logs``."""
    stored = "attack_logs" if table == "security_events" else table
    return spark.read.schema(table_schema(stored)).parquet(f"{root}/{stored}")


def read_table_since(spark: SparkSession, root: str, table: str, since) -> DataFrame:
    """Rows from an instant on; only the folders of its date and later ones are read."""
    stored = read_table(spark, root, table)
    return stored.where((F.col("dt") >= F.to_date(F.lit(since))) & (F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")))


def write_label_map(labels: DataFrame, path: str) -> None:
    """(label_id, label) as one JSON document with id2label, label2id and all_labels. Bounded by the classes."""
    rows = labels.agg(F.array_sort(F.collect_list(F.struct("label_id", "label"))).alias("e"))
    ids = F.transform("e", lambda x: F.struct(x["label_id"].cast("string").alias("key"), x["label"].alias("value")))
    back = F.transform("e", lambda x: F.struct(x["label"].alias("key"), x["label_id"].alias("value")))
    document = F.struct(
        F.map_from_entries(ids).alias("id2label"), F.map_from_entries(back).alias("label2id"), F.transform("e", lambda x: x["label"]).alias("all_labels")
    )
    rows.select(F.to_json(document).alias("value")).coalesce(1).write.text(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, label) of a label map, sorted by label."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.id2label"), T.MapType(T.StringType(), T.StringType()))).alias("id", "label"))
    return pairs.select(F.col("id").cast("long").alias("label_id"), "label").orderBy("label")


def metrics_text(metrics: DataFrame, column: str = "metrics") -> DataFrame:
    """A struct or map as JSON text; any other type as its string form."""
    kind = metrics.schema[column].dataType
    nested = isinstance(kind, (T.StructType, T.MapType))
    return metrics.withColumn(column, F.to_json(column) if nested else F.col(column).cast("string"))
