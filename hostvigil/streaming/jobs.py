"""Structured Streaming forms of the triage, traffic, cooldown, metric and report jobs.

Jobs that keep rows run at a durable.Place that the caller names: started again there, they go on where they stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostvigil.operators import alerts, incidents, metrics, ordered, traffic, triage
from hostvigil.plans import pipelines
from hostvigil.session import materialize, new_path
from hostvigil.sources import files, logs
from hostvigil.streaming import durable, keyed
from hostvigil.streaming.durable import CounterLog, KeyedTimes, Place, Sink

# Of a query with one stateful operator: late rows are told by the current watermark, not by that of the batch before,
# so none can reopen a window whose state is gone and start its count again.
ONE_STATE = {"spark.sql.streaming.statefulOperator.allowMultiple": "false"}


# A file of a segment holds so many rows: one task reads a file, so a batch is read by as many tasks as it has files.
FILE_ROWS = 100_000


class Arrivals:
    """Rows that arrive in segments, as whole files that are moved into the folder of a stream, like rotated logs."""

    def __init__(self, frame: DataFrame, segment: str, count: int, file_rows: int = FILE_ROWS):
        self.spark, self.count = frame.sparkSession, count
        self.staged, self.path = new_path(self.spark, "staged"), new_path(self.spark, "arrived")
        logs.spread(frame).write.partitionBy(segment).option("maxRecordsPerFile", file_rows).parquet(self.staged)
        self.segment, self.schema = segment, frame.drop(segment).schema

    def stream(self, **conf: str) -> DataFrame:
        """The stream of all files that have arrived when it runs, in a session of its own."""
        self._at(self.path, lambda store, path: store.mkdirs(path))
        return durable.stream_session(self.spark, **conf).readStream.schema(self.schema).parquet(f"{self.path}/*")

    def __iter__(self) -> Iterator[int]:
        """Let one segment after the other arrive."""
        for i in range(self.count):
            move = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{i}")
            self._at(f"{self.staged}/{self.segment}={i}", lambda store, path, to=move: store.exists(path) and store.rename(path, to))
            yield i

    def _at(self, path: str, act) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        act(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at)


def new_place(spark: SparkSession, name: str) -> Place:
    """A place for one run."""
    return Place(new_path(spark, name), "rows")


def follow(stream: DataFrame, place: Place, arrivals: Arrivals | None = None, sink: Sink | None = None, mode: str = "append") -> None:
    """Run a stream at its place until it has taken everything; with ``arrivals``, once after each of them."""
    for _ in arrivals if arrivals is not None else [0]:
        durable.start(stream, place, sink, mode).awaitTermination()


def drain(stream: DataFrame, name: str, arrivals: Arrivals | None = None) -> DataFrame:
    """Run a stream over everything that is there or arrives, and read what it has stored."""
    place = new_place(stream.sparkSession, name)
    follow(stream, place, arrivals)
    return durable.read(stream.sparkSession, place, durable.ddl(stream)).drop("batch")


def drain_updates(stream: DataFrame, name: str, keys: list[str], arrivals: Arrivals | None = None) -> DataFrame:
    """Run an aggregating stream in update mode and read the latest row of each key. Its session should have ONE_STATE."""
    place = new_place(stream.sparkSession, name)
    follow(stream, place, arrivals, mode="update")
    rest = [c for c in stream.columns if c not in keys]
    latest = durable.read(stream.sparkSession, place, durable.ddl(stream)).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in stream.columns])


def event_time(frame: DataFrame, delay: str) -> DataFrame:
    """``ts`` as a timestamp with zone, which watermarks need."""
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_triage(lines: DataFrame, score: pipelines.Scorer) -> DataFrame:
    """Triage of a stream: stateless, one pass."""
    return pipelines.stateless_triage(lines, score)


def stream_counters(lines: DataFrame, score: pipelines.Scorer, place: Place, arrivals: Arrivals | None = None) -> CounterLog:
    """Triage a stream into its place and count its lines by outcome on the way, batch by batch."""
    log = CounterLog("triage")
    lines.sparkSession.streams.addListener(log)
    try:
        routed = log.observe(stream_triage(lines, score), **incidents.counters())
        for _ in arrivals if arrivals is not None else [0]:
            query = durable.start(routed, place)
            query.awaitTermination()
            log.wait_for(query)
    finally:
        lines.sparkSession.streams.removeListener(log)
    return log


def stream_traffic_counts(lines: DataFrame, window: str, slide: str, delay: str) -> DataFrame:
    """Requests, errors and first request by sliding window, host, IP and endpoint."""
    requests = event_time(triage.parse_access_log(lines), delay)
    return (
        requests.groupBy(F.window("ts", window, slide).alias("w"), "hostname", "ip", "endpoint")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"), F.min(F.struct("ts", "seq")).alias("first"))
        .select(F.col("w.start").alias("window_start"), "hostname", "ip", "endpoint", "n", "errors", "first")
    )


def traffic_by_window(counts: DataFrame, seconds: int, **thresholds: int) -> DataFrame:
    """Second stage, over counts: the flood report of each window and host, with patterns and risk as in batch."""
    key = ["window_start", "hostname"]

    def leader(name: str) -> DataFrame:
        each = counts.groupBy(*key, name).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        best = F.min(F.struct((-F.col("n")).alias("m"), F.col("first"), F.col(name).alias("name"))).alias("best")
        found = each.groupBy(*key).agg(best, F.count(F.lit(1)).alias(f"unique_{name}s"))
        return found.select(*key, F.col("best.name").alias(f"top_{name}"), (-F.col("best.m")).alias(f"top_{name}_requests"), f"unique_{name}s")

    totals = counts.groupBy(*key).agg(F.sum("n").alias("total_requests"), F.sum("errors").alias("error_requests"))
    windows = totals.join(leader("ip"), key).join(leader("endpoint").drop("unique_endpoints"), key)
    patterns = traffic.with_patterns(windows, seconds, **thresholds)
    shared = {k: thresholds[k] for k in ("request_threshold", "ip_threshold") if k in thresholds}
    return traffic.with_risk(patterns, **shared)


def stream_traffic_windows(lines: DataFrame, window: str, slide: str, delay: str, seconds: int, arrivals: Arrivals | None = None, **thresholds: int) -> DataFrame:
    """Reports of all windows once a stream has ended, open ones too: ``window`` spans ``seconds``. See flood_sink for live ones."""
    counts = drain_updates(stream_traffic_counts(lines, window, slide, delay), "stream-traffic", ["window_start", "hostname", "ip", "endpoint"], arrivals)
    return traffic_by_window(materialize(counts, "stream-counts"), seconds, **thresholds)


def cooldown_since(rows: DataFrame, before: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """The rows of a batch that pass a cooldown which goes on from the last time of each key in ``before`` (keys, ts).

    The last time stands in front of the batch as a row of its own, and the chain goes on from it; older rows are late and
    suppressed.
    """
    last = before.withColumnsRenamed({k: f"_l_{k}" for k in [*keys, "ts"]})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(last[f"_l_{k}"])
    later = rows.join(last, same, "left").where(F.col("_l_ts").isNull() | (F.col("ts") >= F.col("_l_ts"))).select(*rows.columns)
    marks = before.withColumns({"_old": F.lit(True), "seq": F.lit(-1).cast("long")})
    both = later.withColumn("_old", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    return ordered.cooldown(both, keys, seconds).where(~F.col("_old")).drop("_old")


def flood_sink(root: str, seconds: int, cooldown_seconds: float = alerts.COOLDOWN_SECONDS, **thresholds: int) -> Sink:
    """A sink for the closed windows of ``stream_traffic_counts`` in append mode: reports, flood events and alerts.

    All counts of a window leave in the batch in which the watermark closes it, so its report is final, and its alert
    goes out while the stream runs. The cooldown of host and leading IP goes on across batches.
    """
    keys = ["hostname", "top_ip"]
    times = KeyedTimes(f"{root}/flood_times", "hostname STRING, top_ip STRING")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = materialize(batch, "closed-windows")
        reports = traffic_by_window(counts, seconds, **thresholds)
        reports = reports.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "seq": F.unix_micros(F.col("window_start").cast("timestamp"))})
        reports = reports.withColumn("ts", F.col("window_start") + F.expr(f"INTERVAL {seconds} SECONDS"))
        path = f"{root}/flood_reports/batch={batch_id}"
        reports.write.mode("overwrite").parquet(path)
        per = F.col("total_requests") / float(seconds)
        flagged = spark.read.schema(reports.schema).parquet(path).where("is_anomaly").withColumns({"requests_per_second": F.round(per, 2), "requests_per_minute": F.round(per * 60).cast("long")})
        sent = materialize(cooldown_since(flagged, times.before(spark, batch_id), keys, cooldown_seconds), "live-floods")
        events = alerts.flood_rows(sent, seconds)
        files.append_table(events, root, "ddos_events", batch_id)
        files.append_table(alerts.ddos_alerts(events), root, "alerts", batch_id)
        times.write(sent, batch_id)

    return sink


def start_flood_alerts(lines: DataFrame, place: Place, window: str, slide: str, delay: str, seconds: int, cooldown_seconds: float = alerts.COOLDOWN_SECONDS, every: str | None = None, **thresholds: int) -> StreamingQuery:
    """Live flood detection at ``place``: tables flood_reports, ddos_events and alerts below its root."""
    counts = stream_traffic_counts(lines, window, slide, delay)
    return durable.start(counts, place, flood_sink(place.root, seconds, cooldown_seconds, **thresholds), every=every)


def stream_cooldown(rows: DataFrame, keys: list[str], seconds: float, delay: str | None = None, held: int = keyed.HELD_ROWS) -> DataFrame:
    """Kept rows (keys, seq, _us) of a stream; the time of a key's last kept row is its state.

    Without ``delay`` no row is dropped, however late: a row within a cooldown after the last kept row, or older than it,
    is suppressed, and the first row of a key is kept. State is one number per key and stays. With ``delay`` state goes
    once the watermark is a cooldown past it, and Spark drops rows that are older than the watermark.

    Only keys, time and sequence enter Python, in order of time; see keyed.InTimeOrder for how much of a key is held.
    """
    span = int(seconds * 1_000_000)
    return keyed.scan_by_key(rows.withColumn("_code", F.lit(0).cast("long")), keys, keyed.Chain(span), "", max(1_000_000, span // 16), held, delay)


STATES = ["NORMAL", "WARNING", "CRITICAL"]


def stream_metric_transitions(samples: DataFrame, held: int = keyed.HELD_ROWS) -> DataFrame:
    """Transitions of a stream of samples (hostname, metric, seq, _us, old_state, new_state); the last state is kept."""
    code = (F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")) - 1).cast("long")
    states = metrics.metric_states(samples).select("hostname", "metric", "seq", "ts", code.alias("_code"))
    return keyed.scan_by_key(states, ["hostname", "metric"], keyed.Changes(STATES), "old_state STRING, new_state STRING", 3_600_000_000, held)


def stream_hourly_counts(rows: DataFrame, delay: str) -> DataFrame:
    """Totals and CRITICAL, HIGH and MEDIUM counts by hour."""
    counted = event_time(rows, delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("CRITICAL", "HIGH", "MEDIUM")]
    )
    return counted.select(F.col("w.start").alias("hour"), "total", "critical", "high", "medium")


def stream_hourly_report(rows: DataFrame, arrivals: Arrivals | None = None, delay: str = "1 hour") -> DataFrame:
    return drain_updates(stream_hourly_counts(rows, delay), "stream-hourly", ["hour"], arrivals)


def multi_sink(root: str, seconds: float) -> Sink:
    """A sink that writes the decision, incident and alert tables of each triaged micro-batch, computed once.

    Alerts pass the cooldown of host, label and source across batches: a batch meets the last alert of each key, which
    the batches before left in small tables, and leaves those of its own keys below its id, so a retry finds the old ones.
    """
    keys = ["hostname", "prediction", "source_log"]
    times = KeyedTimes(f"{root}/alert_times", "hostname STRING, prediction STRING, source_log STRING")

    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = materialize(batch.where("decision IS NOT NULL"), "stream-scored")
        decisions = scored.withColumns({"predicted_label": F.col("prediction"), "email_sent": F.col("email_required").cast("int"), "raw_log": F.col("raw_line")})
        files.append_table(decisions, root, "security_decisions", batch_id)
        found = scored.where("decision <> 'IGNORE'").withColumn("raw_log", F.col("raw_line"))
        files.append_table(found, root, "attack_logs", batch_id)
        passing = alerts.passing(found.where(F.col("dispatch")))
        sent = materialize(cooldown_since(passing, times.before(batch.sparkSession, batch_id), keys, seconds), "stream-alerts")
        files.append_table(alerts.attack_rows(sent), root, "alerts", batch_id)
        times.write(sent, batch_id)

    return sink


def stream_multi_sink(lines: DataFrame, score: pipelines.Scorer, seconds: float = alerts.COOLDOWN_SECONDS, arrivals: Arrivals | None = None) -> DataFrame:
    """Triage a stream into three tables, and count their rows and ids."""
    spark, place = lines.sparkSession, new_place(lines.sparkSession, "stream-tables")
    follow(stream_triage(lines, score), place, arrivals, multi_sink(place.root, seconds))
    tables = [files.read_table(spark, place.root, t).select(F.lit(t).alias("table_name"), "id") for t in ("security_decisions", "attack_logs", "alerts")]
    by_id = tables[0].union(tables[1]).union(tables[2]).groupBy("table_name", "id").agg(F.count(F.lit(1)).alias("c"))
    return by_id.groupBy("table_name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids"))


def stream_late_data(rows: DataFrame, delay: str, arrivals: Arrivals | None = None) -> DataFrame:
    """Rows per hour and host that arrived before the watermark passed the end of their hour."""
    counted = event_time(rows, delay).groupBy(F.window("ts", "1 hour").alias("w"), "hostname").agg(F.count(F.lit(1)).alias("n"))
    return drain_updates(counted.select(F.col("w.start").alias("hour"), "hostname", "n"), "stream-late", ["hour", "hostname"], arrivals)
