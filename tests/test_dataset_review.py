import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hostvigil.operators import classify, dataset, evaluate, review
from hostvigil.plans import catalog, oracles
from hostvigil.session import materialize
from hostvigil.sources import files

ROWS = "ord LONG, text STRING, label STRING"


def test_dedup_keeps_the_first_of_very_many_copies(spark):
    rows = spark.range(20_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 > 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("label"))
    out = dataset.dedup_keep_first(rows.repartition(7))
    assert out.count() == 6667 + 1 and out.where("text = 'copy'").first().label == "1" and out.columns == rows.columns


def test_clean(spark):
    rows = [(1, "a", "x"), (2, None, "x"), (3, "  ", "x"), (4, "b", None), (5, "　", "x")]
    assert [r.ord for r in dataset.clean_dataset_text(spark.createDataFrame(rows, ROWS)).collect()] == [1]
    repaired = spark.sql("SELECT 1 AS ord, CAST(X'61FF' AS STRING) AS text, 'x' AS label")
    assert dataset.clean_dataset_text(repaired).first().text == "a�"


def test_split_is_exact_per_label(spark):
    rows = spark.range(1110).select(F.col("id").alias("ord"), F.lit("t").alias("text"), F.when(F.col("id") < 1000, "big").when(F.col("id") < 1100, "mid").otherwise("small").alias("label"))
    counts = Counter((r.label, r.split) for r in dataset.stratified_split(rows).collect())
    assert counts == {("big", "train"): 800, ("big", "validation"): 100, ("big", "test"): 100, ("mid", "train"): 80, ("mid", "validation"): 10, ("mid", "test"): 10, ("small", "train"): 8, ("small", "validation"): 1, ("small", "test"): 1}
    again = {(r.ord, r.split) for r in dataset.stratified_split(rows.repartition(9)).collect()}
    assert again == {(r.ord, r.split) for r in dataset.stratified_split(rows).collect()}


def test_statistics(spark):
    rows = spark.createDataFrame([(i, str(i), "XSS" if i % 3 else "WebShell") for i in range(9)], ROWS)
    assert {(r.label, r["count"], r.percentage, r.type) for r in dataset.dataset_statistics(rows).collect()} == {("XSS", 6, 66.67, "Web"), ("WebShell", 3, 33.33, "Server")}
    assert tuple(dataset.server_web_ratio(rows).first()) == (3, 6, 33.33, 66.67)
    assert tuple(dataset.dataset_summary(rows).first()) == (9, 2)
    assert tuple(dataset.dataset_summary(rows.limit(0)).first()) == (0, 0)


def test_retrain_merge_prefers_main_rows(spark):
    main = spark.createDataFrame([(1, "a", "XSS"), (2, "b", "XSS")], ROWS)
    new = spark.createDataFrame([(1, "a", "RCE", "approved"), (2, "c", "Token_Theft", "approved"), (3, "d", "RCE", "rejected")], ROWS + ", status STRING")
    out = {(r.text, r.label, r.label_id) for r in dataset.retrain_merge(main, new).collect()}
    assert out == {("a", "XSS", 1), ("b", "XSS", 1), ("c", "Token_Theft", 0)}


def test_csv_round_trip(spark, tmp_path):
    texts = ['say "hi", she said', "two\nlines", " padded ", "back\\slash", 'quote at end "', "é　", "\\", "cr\r\nlf"]
    rows = spark.createDataFrame([(x, "l") for x in texts] + [(None, "l"), ("", "l"), ("x", None)], "text STRING, label STRING")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(r.text for r in files.read_labeled_dataset(spark, str(tmp_path / "csv")).collect()) == sorted(texts)


def test_queue_round_trip_keeps_long_ids(spark, tmp_path):
    row = ("20260815121041234152", "2026-08-15 12:10:41.234193", 'GET "/x"', "Benign", 0.2124, "cli", "pending", "")
    queue = spark.createDataFrame([row], files.REVIEW_SCHEMA.replace("TIMESTAMP_NTZ", "STRING")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    files.write_csv(queue, str(tmp_path / "q"))
    assert files.read_review_queue(spark, str(tmp_path / "q")).collect() == queue.collect()


def test_apply_reviews(spark):
    queue = spark.createDataFrame([("1", "pending", ""), ("2", "pending", ""), ("3", "approved", "A"), ("4", "pending", "")], "id STRING, status STRING, reviewed_label STRING")
    verdicts = [("1", 1, "reject", None), ("1", 2, "approve", "XSS"), ("2", 1, "approve", "RCE"), ("2", 2, "reject", None), ("9", 1, "approve", "X"), ("3", 1, "reject", None)]
    out = review.apply_reviews(queue, spark.createDataFrame(verdicts, "id STRING, review_seq LONG, action STRING, label STRING"))
    assert {(r.id, r.status, r.reviewed_label) for r in out.collect()} == {("1", "approved", "XSS"), ("2", "rejected", "RCE"), ("3", "rejected", "A"), ("4", "pending", "")}


def test_metrics_of_classes_never_predicted(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label STRING, predicted_label STRING")
    report = {r.label: r for r in evaluate.classification_report(rows).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].f1, report["a"].support) == (1.0, 0.5, 0.666667, 2)
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    assert report["macro avg"].recall == 0.5 and report["weighted avg"].support == 4
    assert [r.label for r in evaluate.worst_classes(rows, 2).collect()] == ["c", "b"]
    assert evaluate.accuracy(rows).first().accuracy == 0.5
    assert evaluate.summary(rows.limit(0)).first().accuracy is None


TRAIN = [(1, "red apple", "fruit"), (2, "green apple pear", "fruit"), (3, "red car", "car"), (4, "fast car car", "car")]


def test_naive_bayes_by_hand(spark):
    model = classify.nb_train(spark.createDataFrame(TRAIN, ROWS), ["car", "fruit"])
    logp = {r.token: list(r.logp) for r in model.collect()}
    assert logp["apple"] == pytest.approx([math.log(1 / 11), math.log(3 / 11)]) and logp[""] == pytest.approx([math.log(0.5)] * 2)
    docs = spark.createDataFrame([(1, "apple"), (2, "the car"), (3, "unknown words"), (4, "..."), (5, None)], "seq LONG, clean_text STRING")
    scored = {r.seq: r for r in classify.nb_score(docs, model, ["car", "fruit"]).collect()}
    assert (scored[1].prediction, scored[1].confidence) == ("fruit", 0.75)
    assert scored[2].prediction == "car"
    assert all((scored[i].prediction, scored[i].confidence) == ("car", 0.5) for i in (3, 4, 5)), "a tie goes to the first label"
    assert classify.topk_predictions(classify.nb_score(docs, model, ["car", "fruit"]), k=1).count() == 5
    hashed = classify.nb_train(spark.createDataFrame(TRAIN, ROWS), ["car", "fruit"], digits=4)
    rowwise = {r.seq: (r.prediction, r.confidence) for r in classify.nb_udf_scorer(hashed, ["car", "fruit"])(docs).collect()}
    assert rowwise == {**{i: (scored[i].prediction, scored[i].confidence) for i in range(1, 5)}, 5: (None, None)}


def test_naive_bayes_reads_whole_texts_and_hashed_models_are_bounded(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    rows = spark.createDataFrame([(1, "red " + words + " apple", "fruit"), (2, "red " + words + " wheel", "car")], ROWS)
    model = classify.nb_train(rows, ["car", "fruit"])
    assert model.where("token in ('apple', 'wheel', 'w2999')").count() == 3
    docs = spark.createDataFrame([(1, "red " * 2000 + "apple"), (2, "red " * 2000 + "wheel")], "seq LONG, clean_text STRING")
    assert {r.seq: r.prediction for r in classify.nb_score(docs, model, ["car", "fruit"]).collect()} == {1: "fruit", 2: "car"}
    live = classify.nb_score(docs, model, ["car", "fruit"], chars=512)
    assert {r.seq: (r.prediction, r.confidence) for r in live.collect()} == {1: ("car", 0.5), 2: ("car", 0.5)}
    assert classify.nb_train(rows, ["car", "fruit"], digits=2).count() <= 257


def test_scoring_with_a_model_too_big_to_broadcast(spark):
    model = materialize(classify.nb_train(spark.createDataFrame(TRAIN, ROWS), ["car", "fruit"]), "m")
    docs = spark.range(500).select(F.col("id").alias("seq"), F.lit("red car apple").alias("clean_text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert classify.nb_score(docs, model, ["car", "fruit"]).groupBy("prediction").count().collect() == [("car", 500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_class_labels(spark):
    rows = spark.range(20).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("label"))
    assert classify.class_labels(rows) == sorted(map(str, range(1, 20)))


def test_udf_scorer_guards(spark):
    def failing_model():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model failed")
            return [("XSS", 0.9)] * len(texts)

        return predict

    rows = [(1, "ok"), (2, "bad"), (3, "  "), (4, None), (5, "x" * 600 + "bad")]
    out = classify.score_with_udf(spark.createDataFrame(rows, "seq LONG, clean_text STRING"), failing_model)
    assert {r.seq: (r.prediction, r.confidence) for r in out.collect()} == {1: ("XSS", 0.9), 2: ("Benign", 0.5), 3: ("Benign", 0.9999), 4: ("Benign", 0.9999), 5: ("XSS", 0.9)}


def test_logistic_regression_saves_and_loads(spark, tmp_path):
    rows = spark.createDataFrame(TRAIN * 5, ROWS)
    model = classify.lr_train(rows, features=256, iterations=20)
    model.write().save(str(tmp_path / "lr"))
    back = type(model).load(str(tmp_path / "lr"))
    assert {(r.text, r.predicted_label) for r in classify.lr_score(rows, back).collect()} == {(t, x) for _, t, x in TRAIN}


def test_logistic_regression_equals_newton_steps(spark):
    """The coefficients are those of an independent solver: ridge on standardised features, an intercept without."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(160):
        label = "pos" if rng.random() < 0.5 else "neg"
        share = np.linspace(1, 3, 12) if label == "pos" else np.linspace(3, 1, 12)
        docs.append((i, " ".join(rng.choice(words, 15, p=share / share.sum())), label))
    model = classify.lr_train(spark.createDataFrame(docs, "ord LONG, text STRING, label STRING"), features=64, iterations=300)
    rows = PipelineModel(model.stages[:-1]).transform(spark.createDataFrame(docs, "ord LONG, text STRING, label STRING")).orderBy("ord").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label_id for r in rows])
    spread = x.std(axis=0, ddof=1)
    used = spread > 0
    full = np.c_[np.ones(len(x)), x[:, used] / spread[used]]
    ridge, beta = np.diag([0.0] + [0.01] * used.sum()), np.zeros(used.sum() + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ beta))
        beta -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / len(x) + ridge, full.T @ (p - y) / len(x) + ridge @ beta)
    found = model.stages[-1].coefficients.toArray()
    assert np.allclose(found[used], beta[1:] / spread[used], atol=2e-3) and abs(model.stages[-1].intercept - beta[0]) < 2e-2
    assert not np.allclose(found[used], 0, atol=0.05)


def test_shared_and_joined_models_score_alike(spark):
    docs = spark.createDataFrame([(1, "apple apple engine"), (2, "engine wheel"), (3, None), (4, ""), (5, "unknown"), (6, "apple " * 300)], "seq LONG, clean_text STRING")
    train = spark.createDataFrame([("apple pear", "fruit"), ("engine wheel", "car"), ("apple", "fruit")], "text STRING, label STRING")
    model = classify.nb_train(train, ["car", "fruit"]).cache()
    shared = classify.nb_score(docs, model, ["car", "fruit"])
    joined = classify.nb_score(docs, model, ["car", "fruit"], shared=0)
    assert "Exchange" not in shared._jdf.queryExecution().executedPlan().toString()
    key = lambda f: sorted((r.seq, r.prediction, r.confidence, [(s.label, round(s.score, 9)) for s in r.scores]) for r in f.collect())
    assert key(shared) == key(joined) and shared.columns == joined.columns


def test_the_shared_part_of_a_model_is_flat(spark, monkeypatch):
    """What each Python worker holds are arrays of about the size of the texts and numbers, not one object a token."""
    model = spark.range(20_000).select(F.concat(F.lit("token"), "id").alias("token"), F.array(F.lit(-1.0), F.lit(-2.0)).alias("logp"))
    model = model.union(spark.createDataFrame([("", [-0.5, -0.7])], "token STRING, logp ARRAY<DOUBLE>"))
    given = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: given.append(value))
    classify.log_sums(model)
    assert len(given) == 1 and sum(part.nbytes for part in given[0]) < 50 * 20_000


def test_rows_of_one_label_are_encoded_where_they_are(spark):
    child = spark.newSession()
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        child.conf.set(key, value)
    rows = child.range(1000, numPartitions=8).select(F.col("id").alias("ord"), F.lit("x").alias("label"))
    encoded = dataset.label_encode(rows).withColumn("at", F.spark_partition_id()).collect()
    assert len(encoded) == 1000 and {r.label_id for r in encoded} == {0}
    assert len({r["at"] for r in encoded}) == 8


def test_of_a_large_model_only_rare_tokens_are_shuffled(spark):
    rare = [(100 + i, f"red red w{i} apple", "fruit" if i % 2 else "car") for i in range(300)]
    labels = ["car", "fruit"]
    model = materialize(classify.nb_train(spark.createDataFrame(TRAIN + rare, ROWS), labels), "m")
    head, tail = classify.parted(model, 100)
    assert {"", "red", "apple"} <= {r.token for r in head.collect()} and head.count() <= 130
    assert head.unionAll(tail).exceptAll(model).count() == 0 and head.count() + tail.count() == model.count()
    docs = spark.createDataFrame([(i, f"red apple w{i} w{i} wheel new{i}") for i in range(300)] + [(300, None), (301, "")], "seq LONG, clean_text STRING")
    rest = docs.select("seq", classify.log_sums(head)(classify.features(F.col("clean_text")))["rest"].alias("r")).select("seq", F.inline("r")).collect()
    known = {r.token for r in head.collect()}
    assert {(r.seq, r.token, r.times) for r in rest} == {(i, t, n) for i in range(300) for t, n in ((f"w{i}", 2), (f"new{i}", 1), ("wheel", 1)) if t not in known}
    key = lambda f: sorted((r.seq, r.prediction, r.confidence, [(s.label, round(s.score, 9)) for s in r.scores]) for r in f.collect())
    assert key(classify.nb_score(docs, model, labels, shared=200)) == key(classify.nb_score(docs, model, labels))


def test_logistic_regression_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, f"word{i % 7} {'red' if i % 2 else 'blue'}", "ab"[i % 2]) for i in range(200)], ROWS)
    model = classify.lr_train(rows.select("label", seen("text").alias("text")))
    assert read.value == 200
    assert classify.lr_score(rows, model).where("predicted_label = label").count() == 200


def test_an_occurrence_of_a_token_moves_one_counter(spark):
    labels = [f"l{i}" for i in range(15)]
    rows = spark.createDataFrame([(0, "a a b", "l0"), (1, "a", "l14"), (2, "c", None), (3, "c d", "other")], ROWS)
    counts = classify.token_counts(rows, labels)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") == 1
    found = {r.token: {labels[i]: n for i, n in enumerate(r.counts) if n} for r in counts.collect()}
    assert found == {"a": {"l0": 2, "l14": 1}, "b": {"l0": 1}, "c": {}, "d": {}}


def test_logistic_regression_scores_and_teaches_with_odd_rows(spark):
    rows = spark.createDataFrame([*TRAIN * 5, (90, None, "car"), (91, "apple", None)], ROWS)
    model = classify.lr_train(rows, features=256)
    assert list(model.stages[0].labels) == ["car", "fruit"]
    odd = spark.createDataFrame([(1, None, None), (2, "", "car"), (3, "red apple", None)], "ord LONG, text STRING, extra STRING")
    scored = classify.lr_score(odd, model)
    assert scored.columns == ["ord", "text", "extra", "predicted_label", "confidence"]
    found = {r.ord: (r.text, r.predicted_label, round(r.confidence, 6)) for r in scored.collect()}
    assert found[1][0] is None and found[2][0] == "" and found[1][1:] == found[2][1:] and found[3][:2] == ("red apple", "fruit")


@pytest.mark.parametrize("gaps", [False, True])
def test_logistic_regression_is_judged_on_every_test_row(spark, tmp_path, gaps):
    """Rows that naive Bayes is unsure of, gets wrong or cannot name count, and with gaps those without text or label."""
    own = {"de": "und", "en": "the", "es": "los", "it": "che"}  # naive Bayes has no "it"

    def text(word, i):
        return None if gaps and i == 50 else f"{word}{i % 5}" if i % 4 == 0 else " ".join(f"{word}{(i + k) % 5}" for k in range(12))

    docs = [(1000 * j + i, text("und" if label == "es" and i % 2 else word, i), label) for j, (label, word) in enumerate(own.items()) for i in range(100)]
    docs += [(9000 + i, "the1 the2 the3", None) for i in range(10 * gaps)]
    spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.label: (r.n, r.floor_met, r.on_scale) for r in catalog.QUERIES["lr_train_score"](spark, str(tmp_path)).collect()}
    assert found == {label: (10, label != "es", True) for label in own} | ({None: (1, True, True)} if gaps else {})  # half of es reads like de
    con = duckdb.connect()
    for table in ("documents", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert {row[0]: row[1] for row in con.sql(oracles.oracle_sql()["lr_train_score"]).fetchall()} == {label: n for label, (n, _, _) in found.items()}
