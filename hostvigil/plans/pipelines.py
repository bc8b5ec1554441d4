"""Whole flows composed from operators: line triage, ad-hoc analysis, evaluation and retraining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.functions import decisions as d
from hostvigil.functions.text import is_blank, strip
from hostvigil.operators import classify, dataset, evaluate, incidents, review, traffic, triage
from hostvigil.operators.ordered import evaluate_once, null_safe_join
from hostvigil.session import materialize

Scorer = Callable[[DataFrame], DataFrame]


def prepare_lines(lines: DataFrame, honor_suspicious: bool = False) -> DataFrame:
    """Pre-filter decision and payload of each line; benign lines get no payload.

    With ``honor_suspicious`` the noise filter does not apply to lines with an override keyword.
    """
    checked = triage.prefilter_classify(lines).select(*lines.columns, F.col("decision").alias("pre_decision"))
    spared = (F.col("pre_decision") == "SUSPICIOUS") if honor_suspicious else None
    benign = F.col("pre_decision") == "BENIGN"
    # A benign line goes on as NULL, which no pattern is tried on.
    masked = checked.withColumnRenamed("raw_line", "_raw").withColumn("raw_line", F.when(~benign, F.col("_raw")))
    texts = triage.with_clean_text(masked, spared).select(*[F.col("_raw").alias(c) if c == "raw_line" else F.col(c) for c in checked.columns], "clean_text")
    return evaluate_once(texts, "pre_decision", "clean_text")


def triage_pipeline(lines: DataFrame, score: Scorer, honor_suspicious: bool = False, write_scored: bool = True) -> DataFrame:
    """Every line with its route: BENIGN, NOISE, IGNORE, LOG_ONLY or ALERT, and the decision fields of scored lines.

    The prepared lines are written once (``write_scored``) and read for both kinds of line, so that no pattern is matched
    twice; a stateless scorer does better with stateless_triage.
    """
    prepared = prepare_lines(lines, honor_suspicious)
    prepared = materialize(prepared, "triage") if write_scored else prepared
    decided = incidents.decide(score(prepared.where("clean_text IS NOT NULL")))
    routed = final_fields(decided)
    rest = prepared.where("clean_text IS NULL").withColumn("route", F.when(F.col("pre_decision") == "BENIGN", "BENIGN").otherwise("NOISE"))
    return routed.unionByName(rest, allowMissingColumns=True)


def final_fields(decided: DataFrame) -> DataFrame:
    """Route, stored risk and status, and whether an alert is dispatched."""
    alert = F.col("decision") == "ALERT"
    risk = F.when(alert, d.final_severity(F.col("severity"), F.col("risk_level"))).when(F.col("decision") == "LOG_ONLY", "SAFE")
    stored = decided.withColumns(
        {"route": F.col("decision"), "risk": risk, "status": F.when(alert, "new").when(F.col("decision") == "LOG_ONLY", "low_confidence")}
    )
    return stored.withColumn("dispatch", alert & F.col("email_required") & d.high_or_critical(F.col("risk")))


def stateless_triage(lines: DataFrame, score: Scorer, honor_suspicious: bool = False) -> DataFrame:
    """The same rows in one pass without a shuffle, for a scorer that adds columns row by row; also runs on a stream."""
    decided = final_fields(incidents.decide(score(prepare_lines(lines, honor_suspicious))))
    unscored = F.col("clean_text").isNull()
    route = F.when(F.col("pre_decision") == "BENIGN", "BENIGN").when(unscored, "NOISE").otherwise(F.col("route"))
    added = [c for c in decided.columns if c not in (*lines.columns, "pre_decision", "clean_text", "route")]
    return decided.select(*lines.columns, "pre_decision", "clean_text", route.alias("route"), *[F.when(~unscored, F.col(c)).alias(c) for c in added])


def analyze_on_demand(lines: DataFrame, score: Scorer, floods: dict[str, int] | None = None) -> DataFrame:
    """Ad-hoc evaluation: every line that is not blank is scored, on its payload or else on itself.

    Where the scorer gives all scores, top3 holds the three best labels with scores. With ``floods``, the arguments of
    ``traffic_report``, a line that is an access record carries the report of its request in ddos_analysis, all others NULL,
    and flood_dispatch says whether it raises a flood alert. (hostname, seq) must be unique.
    """
    # What shapes a line is a step of its own: fused with the patterns, the code is too long to be compiled.
    kept = evaluate_once(lines, "raw_line").where(~is_blank(F.col("raw_line")))
    checked = triage.prefilter_classify(kept).select(*lines.columns, F.col("decision").alias("pre_decision"))
    text = triage.with_clean_text(checked).withColumn("clean_text", F.coalesce("clean_text", strip(F.col("raw_line"))))
    stored = materialize(text, "adhoc")
    decided = incidents.decide(score(stored))
    if "scores" in decided.columns:
        best = F.transform(F.slice("scores", 1, 3), lambda s: F.struct(s["label"].alias("label"), F.round(s["score"], 4).alias("score")))
        decided = decided.withColumn("top3", best).drop("scores")
    if floods is not None:
        requests = triage.parse_access_log(stored.select("seq", "ts", "hostname", "raw_line")).select("seq", "ts", "hostname", "ip", "endpoint", "method", "status")
        report = traffic.traffic_report(requests, **floods)
        analysis = F.struct(*[c for c in report.columns if c not in requests.columns]).alias("ddos_analysis")
        decided = null_safe_join(decided, report.select("hostname", "seq", analysis), ["hostname", "seq"], "left")
        decided = decided.withColumn("flood_dispatch", F.coalesce("ddos_analysis.is_anomaly", F.lit(False)))
    alert = F.col("decision") == "ALERT"
    return decided.withColumns(
        {
            "risk_percentage": F.round(F.col("confidence") * 100.0, 2),
            "stored_risk": F.when(alert, F.col("severity")),
            "status": F.when(alert, "manual_eval"),
            "dispatch": F.col("email_required") & d.high_or_critical(F.col("severity")),
        }
    )


def train_and_score(rows: DataFrame, labels: list[str], seed: int = 42, key: str = "ord") -> DataFrame:
    """Train naive Bayes on the train part and score the test part: label, predicted_label, confidence."""
    parts = materialize(dataset.stratified_split(rows, seed), "parts", "split")
    model = materialize(classify.nb_train(parts.where("split = 'train'"), labels), "nb-model")
    scored = classify.nb_score(parts.where("split = 'test'"), model, labels, key, "text")
    return scored.withColumnRenamed("prediction", "predicted_label")


def evaluate_run(rows: DataFrame, labels: list[str], seed: int = 42, key: str = "ord") -> DataFrame:
    """Test-part accuracy and weighted precision, recall and F1."""
    return evaluate.summary(train_and_score(rows, labels, seed, key))


def predict_and_flag(rows: DataFrame, score: Scorer) -> DataFrame:
    """Score rows and queue the uncertain ones, whatever their label."""
    return review.queue_unknown(score(rows), exclude_benign=False)


def retrain_cycle(main: DataFrame, queue: DataFrame, seed: int = 42) -> DataFrame:
    """Export approved findings, merge them into the dataset, retrain and evaluate.

    The merged dataset and the model are written to new folders, so earlier versions stay.
    """
    approved = queue.where("status = 'approved'").select(
        F.col("id").cast("long").alias("ord"), F.col("raw_log").alias("text"), F.col("reviewed_label").alias("label"), "status"
    )
    merged = materialize(dataset.retrain_merge(main, approved), "dataset")
    keyed = merged.select(F.format_string("%d-%d", "origin", "ord").alias("ord"), "text", "label")
    return evaluate_run(keyed, classify.class_labels(merged), seed)
