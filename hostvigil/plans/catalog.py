"""One query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.functions import patterns as p
from hostvigil.functions.text import sanitize
from hostvigil.operators import alerts, classify, dataset, evaluate, incidents, lookups, metrics, ordered, patterns, review, traffic, triage
from hostvigil.plans import pipelines
from hostvigil.plans.fixtures import COOLDOWN, DOCUMENT_LABELS, LINE_LABELS, TRAFFIC, WINDOW, adapter
from hostvigil.session import materialize, new_path
from hostvigil.sources import files, logs, registry, rollups, stored
from hostvigil.streaming import durable, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def on(name: str, source: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query that is one expression over one adapter."""
    QUERIES[name] = lambda spark, sf: build(adapter(spark, sf, source))


def columns(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda frame: frame.select(*names)


# --- shared inputs ---
def lines(spark: SparkSession, sf: str, name: str = "fx_syslog") -> DataFrame:
    return logs.spread(adapter(spark, sf, name))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return triage.parse_access_log(lines(spark, sf, "fx_access")).select("seq", "ts", "hostname", "ip", "endpoint", "method", "status")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.traffic_report(requests(spark, sf), **TRAFFIC)


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.decide(adapter(spark, sf, "fx_pred"))


def incident_rows(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.incident_rows(decided(spark, sf)).withColumn("raw_log", F.col("clean_text"))


def latest(frame: DataFrame, ts: str = "ts") -> Column:
    return frame.agg(F.max(ts)).scalar()


def flood_events(spark: SparkSession, sf: str) -> DataFrame:
    # Windows are the costly part, and the cooldown reads its input twice.
    flagged = materialize(reports(spark, sf).where("is_anomaly"), "floods")
    return alerts.ddos_events(flagged, COOLDOWN, WINDOW)


def security_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.security_alerts(materialize(incident_rows(spark, sf), "incidents"), COOLDOWN)


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alert_lifecycle(adapter(spark, sf, "fx_metrics"), COOLDOWN)


# A live predictor: hashed tokens and the first characters of a line.
LIVE = {"digits": classify.HASH_DIGITS, "chars": classify.LIVE_CHARS}


def line_model(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(classify.nb_train(lines(spark, sf, "fx_train"), LINE_LABELS, classify.HASH_DIGITS), "line-model")


def line_scorer(spark: SparkSession, sf: str) -> pipelines.Scorer:
    model = line_model(spark, sf)
    return lambda frame: classify.nb_score(frame, model, LINE_LABELS, **LIVE).drop("scores")


def row_scorer(spark: SparkSession, sf: str) -> pipelines.Scorer:
    return classify.nb_udf_scorer(line_model(spark, sf), LINE_LABELS)


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = logs.spread(adapter(spark, sf, "fx_labeled"))
    train = materialize(dataset.stratified_split(docs), "parts", "split").where("split = 'train'")
    model = materialize(classify.nb_train(train, DOCUMENT_LABELS), "document-model")
    return classify.nb_score(docs, model, DOCUMENT_LABELS, "ord", "text")


# --- sources and sinks ---
def written_lines(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "lines")
    rows = adapter(spark, sf, "fx_syslog").select(F.regexp_extract("source_log", "([a-z0-9]+)\\.log$|syslog", 1).alias("source"), F.col("raw_line").alias("value"))
    rows.write.partitionBy("source").text(path)
    return path


def with_source(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("source_log", "source=([a-z0-9]+)/", 1)
    return lines.select(F.when(name == "", "").otherwise(name).alias("source"), "raw_line")


@query("read_log_lines")
def _(spark, sf):
    return with_source(logs.read_log_lines(spark, [written_lines(spark, sf)]))


@query("stream_log_lines")
def _(spark, sf):
    return with_source(jobs.drain(logs.stream_log_lines(durable.stream_session(spark), written_lines(spark, sf)), "tail"))


@query("read_labeled_dataset")
def _(spark, sf):
    path = new_path(spark, "dataset")
    files.write_csv(adapter(spark, sf, "fx_dirty").select("text", "label"), path)
    return files.read_labeled_dataset(spark, path)


@query("read_review_queue")
def _(spark, sf):
    path = new_path(spark, "queue")
    files.write_csv(adapter(spark, sf, "fx_review"), path)
    return files.read_review_queue(spark, path)


@query("write_dataset")
def _(spark, sf):
    rows = built(spark, sf).select("text", "label")
    paths = files.write_dataset(rows, dataset.dataset_statistics(rows), new_path(spark, "export"))
    back = {"csv": files.read_labeled_dataset(spark, paths["csv"]), "json": spark.read.schema(files.DATASET_SCHEMA).json(paths["json"])}
    return back["csv"].select(F.lit("csv").alias("format"), "text", "label").union(back["json"].select(F.lit("json"), "text", "label"))


@query("write_predictions")
def _(spark, sf):
    paths = files.write_predictions(adapter(spark, sf, "fx_eval"), new_path(spark, "predictions"))
    parts = [spark.read.parquet(path).select(F.lit(name).alias("part"), "*") for name, path in paths.items()]
    return parts[0].unionByName(parts[1])


def stored_tables(spark: SparkSession, sf: str) -> str:
    """All incident tables below a new folder."""
    root = new_path(spark, "tables")
    files.append_table(incident_rows(spark, sf), root, "attack_logs")
    files.append_table(
        decided(spark, sf).withColumns({"raw_log": F.col("clean_text"), "predicted_label": F.col("prediction"), "email_sent": F.col("email_required").cast("int")}),
        root, "security_decisions",
    )
    floods = materialize(flood_events(spark, sf), "flood-events")
    files.append_table(floods, root, "ddos_events")
    files.append_table(alerts.ddos_alerts(floods), root, "alerts")
    files.append_table(security_alerts(spark, sf), root, "alerts")
    cycle = materialize(lifecycle(spark, sf), "lifecycle")
    files.append_table(cycle, root, "alerts")
    raised = cycle.where("alert_type <> 'RECOVERY'").withColumns({"metric_name": F.col("metric"), "threshold_value": F.col("threshold")})
    files.append_table(raised, root, "resource_alerts")
    health = metrics.health_snapshot(adapter(spark, sf, "fx_metrics")).withColumns({"ts": F.col("tick"), "seq": F.unix_micros(F.col("tick").cast("timestamp"))})
    files.append_table(health, root, "system_health")
    return root


@query("append_security_tables")
def _(spark, sf):
    root = stored_tables(spark, sf)
    counted = [files.read_table(spark, root, t).select(F.lit(t).alias("table_name"), "id") for t in [*files.TABLES, "security_events"]]
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.union(other)
    by_id = rows.groupBy("table_name", "id").agg(F.count(F.lit(1)).alias("c"))
    return by_id.groupBy("table_name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids"))


@query("stored_alerts")
def _(spark, sf):
    rows = files.read_table(spark, stored_tables(spark, sf), "alerts")
    full = F.col("description").isNotNull() & F.col("metrics").isNotNull() & F.col("id").isNotNull()
    return rows.select("hostname", "seq", "timestamp", "alert_type", "severity", "source", "status", "resolved_at", F.col("dt").cast("string").alias("dt"), full.alias("complete"))


@query("stored_resolve")
def _(spark, sf):
    """Recoveries written into a stored table of active alerts."""
    root = new_path(spark, "stored")
    changes = materialize(metrics.transitions(adapter(spark, sf, "fx_metrics")), "transitions")
    raised = ordered.cooldown(metrics.alert_candidates(changes), ["hostname", "alert_type", "metric"], COOLDOWN)
    source = F.concat(F.lit("ResourceMonitor:"), "metric")
    stored.append_incidents(alerts.with_resource_text(raised).withColumns({"source": source, "status": F.lit("ACTIVE")}), root, "alerts")
    stored.resolve_alerts(spark, root, changes.where("event_type = 'RECOVERY'"))
    metric = F.regexp_extract("alert_type", "^(.+)_", 1).alias("metric")
    return stored.incident_table(spark, root, "alerts").read().select("hostname", metric, "seq", "alert_type", "status", "resolved_at")


@query("stored_reviews")
def _(spark, sf):
    """Verdicts written into a stored review queue."""
    root = new_path(spark, "stored")
    stored.queue_reviews(adapter(spark, sf, "fx_review"), root)
    stored.apply_reviews(spark, root, adapter(spark, sf, "fx_verdicts"))
    return stored.review_table(spark, root).read().select("id", "status", "reviewed_label")


@query("stored_recent")
def _(spark, sf):
    """The newest incidents of a stored table; only the newest dates are opened."""
    root = new_path(spark, "stored")
    stored.append_incidents(incident_rows(spark, sf), root, "attack_logs")
    return stored.recent_incidents(spark, root, 50, "MEDIUM").select("seq", "hostname", "prediction", "risk", "status")


def counted_tables(spark: SparkSession, sf: str, *more: str) -> str:
    """Incidents in three batches, the last of which runs twice, and the other tables named, with their hourly counts."""
    root, rows = new_path(spark, "counted"), materialize(incident_rows(spark, sf), "incidents")
    for batch in (0, 1, 2, 2):
        rollups.append_counted(rows.where(F.col("seq") % 3 == batch), root, "attack_logs", batch)
    if "ddos_events" in more:
        rollups.append_counted(flood_events(spark, sf), root, "ddos_events", 0)
    if "resource_alerts" in more:
        raised = metrics.resource_alerts(adapter(spark, sf, "fx_metrics"), COOLDOWN)
        rollups.append_counted(raised.withColumns({"metric_name": F.col("metric"), "threshold_value": F.col("threshold")}), root, "resource_alerts", 0)
    return root


@query("stored_statistics")
def _(spark, sf):
    """The summary of stored tables from their hourly counts."""
    root = counted_tables(spark, sf, "ddos_events", "resource_alerts")
    return rollups.statistics(spark, root, latest(adapter(spark, sf, "fx_pred")))


QUERIES["stored_hourly_report"] = lambda spark, sf: rollups.hourly_report(spark, counted_tables(spark, sf))
QUERIES["stored_risk_breakdown"] = lambda spark, sf: rollups.risk_breakdown(spark, counted_tables(spark, sf))
QUERIES["stored_top_attack_types"] = lambda spark, sf: rollups.top_attack_types(spark, counted_tables(spark, sf))


@query("dual_write_events")
def _(spark, sf):
    root = new_path(spark, "tables")
    files.append_table(incident_rows(spark, sf), root, "attack_logs")
    both = [files.read_table(spark, root, t).select(F.lit(t).alias("table_name"), "seq", "prediction", "risk", "status") for t in ("attack_logs", "security_events")]
    return both[0].union(both[1])


@query("label_map")
def _(spark, sf):
    path = new_path(spark, "label-map")
    files.write_label_map(dataset.label_ids(adapter(spark, sf, "fx_pred").select(F.col("prediction").alias("label"))), path)
    return files.read_label_map(spark, path)


@query("metrics_json")
def _(spark, sf):
    pred = adapter(spark, sf, "fx_pred")
    detail = F.struct("prediction", F.round(F.col("confidence") * 100.0, 2).alias("confidence_percent"), F.col("source_log").alias("source"))
    text = files.metrics_text(pred.select("seq", detail.alias("metrics")))
    plain = files.metrics_text(text.withColumn("plain", F.col("seq")), "plain")
    back = F.from_json("metrics", "prediction STRING, confidence_percent DOUBLE, source STRING")
    return plain.select("seq", back.alias("m"), "plain").select("seq", "m.*", "plain")


# --- projections, filters, predicates ---
on("prefilter_classify", "fx_triage", lambda x: triage.prefilter_classify(logs.spread(x)).select("seq", "decision", "reason", "matched_pattern"))
on("prefilter_disabled", "fx_triage", lambda x: triage.prefilter_classify(x, enabled=False).select("seq", "decision", "reason", "matched_pattern"))
on("noise_filter", "fx_triage", lambda x: triage.drop_noise(x).select("seq", "raw_line"))
on("extract_clean_text", "fx_triage", lambda x: triage.with_clean_text(x).select("seq", "clean_text"))
on("sanitize_text", "fx_triage", lambda x: x.select("seq", sanitize(F.col("raw_line")).alias("text")))
on("parse_access_log", "fx_access", lambda x: triage.parse_access_log(x).select("seq", "hostname", "ip", "endpoint", "method", "status"))
on("normalize_confidence", "fx_pred", lambda x: x.select("seq", d.normalize_confidence(F.col("confidence")).alias("confidence")))
on(
    "security_decision", "fx_pred",
    lambda x: incidents.decide(x).select("seq", "decision", "is_attack", F.col("prediction").alias("label"), F.col("norm_confidence").alias("confidence"), "severity", "email_required"),
)
on("decision_passthrough", "fx_pred", lambda x: incidents.decide(x, enabled=False).select("seq", "decision", "severity", "email_required", "reason"))
on("risk_level", "fx_pred", lambda x: incidents.decide(x).select("seq", "risk_level"))
on(
    "weighted_risk", "fx_pred",
    lambda x: lookups.weight_lookup(x.withColumn("confidence", d.normalize_confidence(F.col("confidence")))).select("seq", d.weighted_risk(F.col("prediction"), F.col("confidence"), F.col("weight")).alias("r")).select("seq", "r.*"),
)
on(
    "final_severity", "fx_pred",
    lambda x: incidents.decide(x).where("decision = 'ALERT'").select("seq", "severity", "risk_level", d.final_severity(F.col("severity"), F.col("risk_level")).alias("final_severity")),
)
on(
    "flag_unknown", "fx_pred",
    lambda x: review.flag_unknown(x).withColumn("is_unknown_any", d.is_unknown(F.col("prediction"), F.col("confidence"), False)).select("seq", "is_malicious", "is_unknown", "is_unknown_any"),
)
on("queue_unknown", "fx_pred", review.queue_unknown)
on("metric_state", "fx_metrics", lambda x: metrics.metric_states(x).select("seq", "state"))
on("overall_severity", "fx_metrics", metrics.overall_severity)
QUERIES["alert_gate"] = lambda spark, sf: incident_rows(spark, sf).where(d.dispatchable(F.col("risk"), F.col("confidence"))).select("seq", "prediction", "risk")
ROUTED = ["seq", "pre_decision", "clean_text", "route", "prediction", "confidence", "severity", "risk", "status"]


def routed_columns(routed: DataFrame) -> DataFrame:
    return routed.select(*ROUTED, F.coalesce("dispatch", F.lit(False)).alias("dispatch"))


QUERIES["triage_pipeline"] = lambda spark, sf: routed_columns(pipelines.triage_pipeline(lines(spark, sf), line_scorer(spark, sf)))
QUERIES["triage_pipeline_one_pass"] = lambda spark, sf: routed_columns(pipelines.stateless_triage(lines(spark, sf), row_scorer(spark, sf)))


@query("analyze_on_demand")
def _(spark, sf):
    out = pipelines.analyze_on_demand(lines(spark, sf), line_scorer(spark, sf))
    return out.select("seq", "pre_decision", "clean_text", "prediction", "confidence", "risk_percentage", "decision", "severity", "risk_level", "stored_risk", "status", "dispatch")


@query("analyze_on_demand_top3")
def _(spark, sf):
    model = line_model(spark, sf)
    out = pipelines.analyze_on_demand(lines(spark, sf), lambda frame: classify.nb_score(frame, model, LINE_LABELS, **LIVE))
    return out.select("seq", F.posexplode("top3").alias("position", "best")).select("seq", (F.col("position") + 1).alias("rank"), "best.label", "best.score")


@query("analyze_on_demand_traffic")
def _(spark, sf):
    out = pipelines.analyze_on_demand(lines(spark, sf, "fx_access"), line_scorer(spark, sf), TRAFFIC)
    counts = ["total_requests", "requests_per_minute", "unique_ips", "top_ip", "top_ip_requests", "top_endpoint", "top_endpoint_requests", "error_requests", "risk_level"]
    found = [F.col(f"ddos_analysis.{c}").alias(c) for c in counts]
    return out.select("hostname", "seq", *found, F.array_join("ddos_analysis.patterns_detected", "; ").alias("patterns"), "flood_dispatch")


on("clean_dataset_text", "fx_dirty", dataset.clean_dataset_text)


@query("render_notifications")
def _(spark, sf):
    parts = [alerts.resource_outbox(lifecycle(spark, sf)), alerts.flood_outbox(flood_events(spark, sf)), alerts.attack_outbox(security_alerts(spark, sf))]
    whole = F.contains("body", "hostname") & F.contains("body", "description") & F.contains("body", F.lit("what to do"))
    text = F.when(F.col("alert_type").isin("SECURITY_ATTACK", "DDOS_DETECTED"), F.col("description"))
    rows = [part.select("seq", "alert_type", "subject", text.alias("description"), whole.alias("whole")) for part in parts]
    return rows[0].union(rows[1]).union(rows[2])


# --- joins ---
on("severity_lookup", "fx_pred", lambda x: lookups.severity_lookup(x).select("seq", "prediction", "base_severity"))
on("severity_lookup_alt", "fx_pred", lambda x: lookups.severity_lookup_alt(x).select("seq", "prediction", "base_severity"))
QUERIES["sliding_window_join"] = lambda spark, sf: traffic.sliding_count(requests(spark, sf), WINDOW, "n_window").select("hostname", "seq", "n_window")
on("weight_lookup", "fx_pred", lambda x: lookups.weight_lookup(x).select("seq", "prediction", "weight"))
on("recommendation_lookup", "fx_pred", lambda x: lookups.recommendation_lookup(x).select("seq", "prediction", "recommendation"))


@query("pattern_match_join")
def _(spark, sf):
    table = spark.createDataFrame(list(enumerate(p.BENIGN_PATTERNS)), "pattern_id INT, pattern STRING")
    return patterns.first_pattern_match(adapter(spark, sf, "fx_triage"), table).select("seq", "pattern_id", "pattern")


@query("resolve_alerts")
def _(spark, sf):
    changes = materialize(metrics.transitions(adapter(spark, sf, "fx_metrics")), "transitions")
    raised = ordered.cooldown(metrics.alert_candidates(changes), ["hostname", "alert_type", "metric"], COOLDOWN)
    return alerts.resolve_alerts(raised, changes.where("event_type = 'RECOVERY'")).select("hostname", "metric", "seq", "alert_type", "status", "resolved_at")


QUERIES["apply_reviews"] = lambda spark, sf: review.apply_reviews(adapter(spark, sf, "fx_review"), adapter(spark, sf, "fx_verdicts")).select("id", "status", "reviewed_label")
QUERIES["new_labels"] = lambda spark, sf: lookups.new_labels(adapter(spark, sf, "fx_review"), adapter(spark, sf, "labels48"))
on("tag_label_type", "fx_pred", lambda x: lookups.tag_label_type(x.select("seq", F.col("prediction").alias("label"))))

# --- aggregations ---
for _name, _columns in {
    "traffic_top_ip": ["top_ip", "top_ip_requests"],
    "traffic_top_endpoint": ["top_endpoint", "top_endpoint_requests"],
    "traffic_risk": ["risk_level", "is_anomaly"],
}.items():
    QUERIES[_name] = lambda spark, sf, kept=_columns: reports(spark, sf).select("hostname", "seq", *kept)
QUERIES["traffic_counts"] = lambda spark, sf: traffic.traffic_totals(requests(spark, sf), WINDOW, TRAFFIC["minute"]).select(
    "hostname", "seq", "total_requests", "requests_per_second", "requests_per_minute", "unique_ips"
)
QUERIES["traffic_error_count"] = lambda spark, sf: traffic.sliding_count(requests(spark, sf), WINDOW, "error_requests", only=F.col("status") >= 400).select("hostname", "seq", "error_requests")
QUERIES["traffic_patterns"] = lambda spark, sf: reports(spark, sf).select("hostname", "seq", F.array_join("patterns_detected", "; ").alias("patterns"))


@query("traffic_snapshot")
def _(spark, sf):
    rows = requests(spark, sf)
    return traffic.traffic_snapshot(rows, latest(rows), **TRAFFIC).select(
        "hostname", "total_requests", "requests_per_second", "requests_per_minute", "unique_ips", "top_ip", "top_ip_requests", "top_endpoint",
        "top_endpoint_requests", "error_requests", F.array_join("patterns_detected", "; ").alias("patterns"), "risk_level", "is_anomaly",
    )


@query("statistics")
def _(spark, sf):
    raised = metrics.resource_alerts(adapter(spark, sf, "fx_metrics"), COOLDOWN)
    return incidents.statistics(incident_rows(spark, sf), flood_events(spark, sf), raised, latest(adapter(spark, sf, "fx_pred")))


QUERIES["risk_breakdown"] = lambda spark, sf: incidents.risk_breakdown(incident_rows(spark, sf))
QUERIES["top_attack_types"] = lambda spark, sf: incidents.top_attack_types(incident_rows(spark, sf))
QUERIES["last_24h"] = lambda spark, sf: incidents.last_24h(incident_rows(spark, sf), latest(adapter(spark, sf, "fx_pred")))
on("label_distribution", "fx_labeled", dataset.label_distribution)
on("server_web_ratio", "fx_pred", lambda x: dataset.server_web_ratio(x, "prediction"))
on("dataset_summary", "fx_labeled", dataset.dataset_summary)
on("weekly_report", "fx_review", lambda x: review.weekly_report(x, latest(x, "timestamp")))
on("review_stats", "fx_review", review.review_stats)
on("accuracy", "fx_eval", evaluate.accuracy)
on("weighted_prf", "fx_eval", evaluate.weighted_prf)
on("classification_report", "fx_eval", evaluate.classification_report)
on("confusion_matrix", "fx_eval", evaluate.confusion_matrix)
on("worst_classes", "fx_eval", evaluate.worst_classes)
QUERIES["hourly_report"] = lambda spark, sf: incidents.hourly_report(incident_rows(spark, sf))
QUERIES["pipeline_counters"] = lambda spark, sf: incidents.pipeline_counters(
    pipelines.stateless_triage(lines(spark, sf), row_scorer(spark, sf))
)
on("health_snapshot", "fx_metrics", metrics.health_snapshot)


# --- windows and ordered state ---
def all_events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), "ts", "event_type")


QUERIES["cooldown_dedup"] = lambda spark, sf: ordered.cooldown(all_events(spark, sf), ["event_type"], COOLDOWN)


@query("email_dedup")
def _(spark, sf):
    cycle = materialize(lifecycle(spark, sf), "lifecycle")
    shape = ["hostname", "seq", "ts", "alert_type"]
    key = alerts.email_source(F.col("alert_type"), F.col("source"), F.col("prediction")).alias("email_key")
    none = F.lit(None).cast("string").alias("prediction")
    mail = (
        alerts.ddos_alerts(flood_events(spark, sf)).select(*shape, "source", none)
        .union(cycle.select(*shape, "source", none))
        .union(security_alerts(spark, sf).select(*shape, "source", "prediction"))
    )
    return alerts.email_dedup(materialize(mail.select(*shape, key), "mail"), COOLDOWN).select("hostname", "seq", "alert_type", "email_key")


TRANSITION = ["seq", "ts", "hostname", "metric", "current_value", "old_state", "new_state", "event_type", "threshold"]
on("metric_transitions", "fx_metrics", lambda x: metrics.transitions(x).select(*TRANSITION))
on("metric_recoveries", "fx_metrics", lambda x: metrics.recoveries(x).select(*TRANSITION))
on("resource_alerts", "fx_metrics", lambda x: metrics.resource_alerts(x, COOLDOWN))
on("dedup_keep_first", "fx_labeled", dataset.dedup_keep_first)
on("stratified_split", "fx_labeled", lambda x: dataset.stratified_split(x).select("ord", "label", "split"))
QUERIES["topk_predictions"] = lambda spark, sf: classify.topk_predictions(document_scores(spark, sf), "ord")
on(
    "surrogate_id", "fx_pred",
    lambda x: x.select("hostname", incidents.surrogate_id("attack_logs").alias("id")).groupBy("hostname", "id").agg(F.count(F.lit(1)).alias("c"))
    .groupBy("hostname").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids")),
)
QUERIES["alert_lifecycle"] = lambda spark, sf: lifecycle(spark, sf).select(
    "hostname", "metric", "seq", "ts", "alert_type", "severity", "current_value", "threshold", "source", "status", "resolved_at"
)
QUERIES["traffic_alerts"] = lambda spark, sf: flood_events(spark, sf).select(
    "hostname", "seq", "pattern_type", "requests_count", "top_ip", "top_endpoint", "risk_level", "description"
)
QUERIES["security_alerts"] = lambda spark, sf: security_alerts(spark, sf).select("hostname", "seq", "alert_type", "severity", "source", "prediction", "raw_log")

# --- sorts, limits ---
QUERIES["recent_incidents"] = lambda spark, sf: incidents.recent_incidents(incident_rows(spark, sf), 50, "MEDIUM").select("seq", "hostname", "prediction", "risk", "status")
QUERIES["active_alerts"] = lambda spark, sf: incidents.active_alerts(lifecycle(spark, sf)).select("hostname", "seq", "alert_type", "severity")


@query("recent_decisions")
def _(spark, sf):
    rows = decided(spark, sf)
    both = incidents.recent_decisions(rows, 50, "ALERT").unionByName(incidents.recent_decisions(rows, 50, "IGNORE"))
    return both.select("seq", "decision", "severity", "email_required")


on("pending_reviews", "fx_review", lambda x: review.pending_reviews(x).select("id", "raw_log", "predicted_label"))
on("shuffle_rows", "fx_labeled", lambda x: dataset.shuffle_rows(x).select("ord", "order_key"))


# --- set operations ---
def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even rows as the existing samples; odd rows, and some even ones again, as the new ones."""
    rows = adapter(spark, sf, "fx_dirty")
    return rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1").unionByName(rows.where("ord % 4 = 0"))


def built(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.build_dataset(*halves(spark, sf))


QUERIES["union_datasets"] = lambda spark, sf: dataset.union_datasets(*halves(spark, sf))
QUERIES["build_dataset"] = lambda spark, sf: lookups.tag_label_type(built(spark, sf))
QUERIES["retrain_merge"] = lambda spark, sf: dataset.retrain_merge(
    adapter(spark, sf, "fx_labeled"),
    adapter(spark, sf, "fx_review").select(F.col("id").cast("long").alias("ord"), F.col("raw_log").alias("text"), F.col("reviewed_label").alias("label"), "status"),
)
on("export_approved", "fx_review", review.export_approved)

# --- classification ---
on("label_encode", "fx_labeled", lambda x: dataset.label_encode(x).select("ord", "label", "label_id"))
on("tokenize", "fx_labeled", classify.tokenize)


@query("nb_train")
def _(spark, sf):
    train = materialize(dataset.stratified_split(adapter(spark, sf, "fx_labeled")), "parts", "split").where("split = 'train'")
    model = classify.nb_train(train, DOCUMENT_LABELS)
    long = model.select("token", F.posexplode("logp").alias("i", "logp"))
    return long.select("token", F.get(F.lit(DOCUMENT_LABELS), F.col("i")).alias("label"), F.round("logp", 6).alias("logp"))


QUERIES["nb_score"] = lambda spark, sf: document_scores(spark, sf).select("ord", "prediction", "confidence")


@query("predict_guards")
def _(spark, sf):
    model = line_model(spark, sf)
    return classify.with_guards(
        adapter(spark, sf, "fx_syslog"), lambda frame: classify.nb_score(frame, model, LINE_LABELS, "seq", "raw_line", **LIVE), "raw_line"
    ).select("seq", "prediction", "confidence")


@query("lr_train_score")
def _(spark, sf):
    # A statement cannot fit the model, so it holds what must be true of it: every test row is scored, and in each class nine
    # in ten are right, of all rows and of those that naive Bayes, which a statement can fit, gets right with confidence.
    parts = materialize(dataset.stratified_split(adapter(spark, sf, "fx_labeled")), "parts", "split")
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    other = classify.nb_score(test, materialize(classify.nb_train(train, DOCUMENT_LABELS), "document-model"), DOCUMENT_LABELS, "ord", "text")
    marked = other.select("ord", "label", "text", F.expr("prediction = label AND confidence >= 0.99").alias("clear"))
    scored = classify.lr_score(marked, classify.lr_train(train))
    right = (F.col("predicted_label") == F.col("label")).cast("int")
    floors = [F.coalesce(share >= 0.9, F.lit(True)) for share in (F.avg(right), F.avg(F.when(F.col("clear"), right)))]  # a class may have no clear row
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (floors[0] & floors[1]).alias("floor_met"), F.avg("confidence").between(0.5, 1.0).alias("on_scale"))


def keyword_model() -> classify.Model:
    """A stand-in for a user's model."""

    def predict(texts: list[str]) -> list[tuple[str, float]]:
        found = []
        for text in texts:
            low = text.lower()
            label = "Cryptomining" if "xmrig" in low else "SSH_BruteForce" if "failed password" in low else "Benign"
            found.append((label, (50 + len(text) % 50) / 100))
        return found

    return predict


on("score_with_udf", "fx_syslog", lambda x: classify.score_with_udf(x, keyword_model, "raw_line").select("seq", "prediction", "confidence"))
on("evaluate_run", "fx_labeled", lambda x: pipelines.evaluate_run(x, DOCUMENT_LABELS))


@query("model_registry")
def _(spark, sf):
    """A model counted in two parts, loaded in another session and evaluated: the same as one fitted at once."""
    parts = materialize(dataset.stratified_split(adapter(spark, sf, "fx_labeled")), "parts", "split")
    train, path = parts.where("split = 'train'"), new_path(spark, "registry")
    for k in (0, 1, 1):  # a dataset that comes twice counts once
        registry.ModelRegistry(spark, path).add(train.where(F.col("ord") % 2 == k), f"part-{k}")
    labels, model = registry.ModelRegistry(spark.newSession(), path).load()
    scored = classify.nb_score(parts.where("split = 'test'"), model, labels, "ord", "text")
    return evaluate.summary(scored.withColumnRenamed("prediction", "predicted_label"))


@query("predict_and_flag")
def _(spark, sf):
    scored = document_scores(spark, sf).withColumns(
        {"seq": F.col("ord"), "clean_text": F.col("text"), "ts": F.lit(None).cast("timestamp_ntz"), "source_log": F.lit("documents")}
    )
    return pipelines.predict_and_flag(scored, lambda frame: frame).select("id", "raw_log", "predicted_label", "confidence", "status")


QUERIES["retrain_cycle"] = lambda spark, sf: pipelines.retrain_cycle(adapter(spark, sf, "fx_labeled"), adapter(spark, sf, "fx_review"))


# --- streams ---
def segmented(frame: DataFrame, late: bool = False) -> DataFrame:
    """Add the file a row arrives in: its quarter of the time span, or for every tenth row the next one."""
    us = ordered.micros("ts")
    bounds = frame.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    quarter = F.floor(4 * (us - lo) / (hi - lo + 1).cast("double")).cast("long")
    shift = F.when(F.col("seq") % 10 == 0, 1).otherwise(0) if late else F.lit(0)
    return frame.withColumn("segment", F.least(F.lit(3), quarter + shift))


def arriving(spark: SparkSession, frame: DataFrame, late: bool = False) -> jobs.Arrivals:
    return jobs.Arrivals(segmented(frame, late), "segment", 4)


@query("stream_triage")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_syslog"))
    return routed_columns(jobs.drain(jobs.stream_triage(rows.stream(), row_scorer(spark, sf)), "stream-triage", rows))


@query("stream_counters")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_syslog"))
    stream = rows.stream()
    log = jobs.stream_counters(stream, row_scorer(spark, sf), jobs.new_place(spark, "counters"), rows)
    return spark.createDataFrame([log.totals()], ", ".join(f"{k} LONG" for k in incidents.counters()))


LIVE_WINDOWS = ("1 hour", "30 minutes", "2 hours")
LIVE_TRAFFIC = {k: v for k, v in TRAFFIC.items() if k != "minute"}


@query("stream_traffic_windows")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_access"))
    out = jobs.stream_traffic_windows(rows.stream(**jobs.ONE_STATE), *LIVE_WINDOWS, arrivals=rows, **LIVE_TRAFFIC)
    shown = out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "patterns": F.array_join("patterns_detected", "; ")})
    return shown.drop("patterns_detected")


@query("stream_flood_alerts")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_access"))
    stream, place = rows.stream(**jobs.ONE_STATE), jobs.new_place(spark, "live-floods")
    for _ in rows:
        jobs.start_flood_alerts(stream, place, *LIVE_WINDOWS, cooldown_seconds=COOLDOWN, **LIVE_TRAFFIC).awaitTermination()
    events = files.read_table(spark, place.root, "ddos_events")
    return events.select("hostname", "timestamp", "pattern_type", "requests_count", "top_ip", "top_endpoint", "risk_level")


@query("stream_cooldown")
def _(spark, sf):
    rows = arriving(spark, all_events(spark, sf))
    return jobs.drain(jobs.stream_cooldown(rows.stream(), ["event_type"], COOLDOWN), "stream-cooldown", rows).select("event_type", "seq")


class _Lost(Exception):
    """Stands for a driver that is lost."""


@query("stream_restart")
def _(spark, sf):
    """A cooldown whose driver is lost after batch 1 is stored and before it is committed, and which is started again."""
    rows, place = arriving(spark, all_events(spark, sf)), jobs.new_place(spark, "restart")
    stream = jobs.stream_cooldown(rows.stream(), ["event_type"], COOLDOWN)

    def lost(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place.data}/batch={batch_id}")
        if batch_id == 1:
            raise _Lost

    for segment in rows:
        started = durable.start(stream, place, lost if segment < 2 else None)
        try:
            started.awaitTermination()
        except StreamingQueryException:
            if segment != 1:
                raise
    return durable.read(spark, place, durable.ddl(stream)).select("event_type", "seq")


@query("stream_metric_transitions")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_metrics"))
    found = jobs.drain(jobs.stream_metric_transitions(rows.stream()), "stream-transitions", rows)
    return found.select("hostname", "metric", "seq", "old_state", "new_state")


@query("stream_hourly_report")
def _(spark, sf):
    rows = arriving(spark, incident_rows(spark, sf).select("seq", "ts", "risk"))
    return jobs.stream_hourly_report(rows.stream(**jobs.ONE_STATE), rows).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_multi_sink")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_syslog"))
    return jobs.stream_multi_sink(rows.stream(), row_scorer(spark, sf), COOLDOWN, rows)


@query("stream_late_data")
def _(spark, sf):
    rows = arriving(spark, adapter(spark, sf, "fx_syslog").select("seq", "ts", "hostname"), late=True)
    return jobs.stream_late_data(rows.stream(**jobs.ONE_STATE), "48 hours", rows).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of all predictions by outcome and severity."""
    return decided(spark, sf).groupBy("decision", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("email_required")).alias("emails"))
