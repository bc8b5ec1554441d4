from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hostvigil.operators import classify, incidents, metrics, ordered
from hostvigil.plans import pipelines
from hostvigil.sources import files, logs
from hostvigil.streaming import durable, jobs

START = datetime(2026, 1, 1)


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  one \n\n \t\nbad \xff byte\r\n")
    (tmp_path / "b.log").write_text("two\n")
    rows = logs.read_log_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).collect()
    assert sorted((Path(r.source_log).name, r.raw_line) for r in rows) == [("a.log", "bad � byte"), ("a.log", "one"), ("b.log", "two")]


def test_tail_resumes_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    def run():
        stream = logs.stream_log_lines(spark, str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.raw_line for r in spark.read.parquet(str(tmp_path / "out")).collect())
    (tmp_path / "in" / "1.log").write_text("one\n")
    assert run() == ["one"]
    (tmp_path / "in" / "2.log").write_text("two\n")
    assert run() == ["one", "two"]


def test_retried_batch_replaces_its_rows(spark, tmp_path):
    full = "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, source_log STRING, raw_log STRING, clean_text STRING, prediction STRING, confidence DOUBLE, risk STRING"
    rows = spark.createDataFrame([(1, START, "vps", "/a", "x", "x", "XSS", 0.9, "HIGH")], full)
    for _ in range(2):
        files.append_table(rows, str(tmp_path), "attack_logs", batch_id=7)
    assert files.read_table(spark, str(tmp_path), "attack_logs").count() == 1
    files.append_table(rows.withColumn("seq", F.col("seq") + 1), str(tmp_path), "attack_logs", batch_id=8)
    events = files.read_table(spark, str(tmp_path), "security_events")
    assert events.count() == 2 and events.select("id").distinct().count() == 2
    assert dict(events.dtypes)["confidence"] == "double" and dict(events.dtypes)["timestamp"] == "timestamp_ntz"
    with pytest.raises(ValueError):
        files.append_table(rows.drop("risk"), str(tmp_path), "attack_logs")
    assert files.read_table_since(spark, str(tmp_path), "attack_logs", START).count() == 2
    assert files.read_table_since(spark, str(tmp_path), "attack_logs", START + timedelta(days=1)).count() == 0


def test_line_ends_and_paths(spark, tmp_path):
    folder = tmp_path / "a b+c"
    folder.mkdir()
    (folder / "x.log").write_bytes(b"one\rtwo\r\nthree\n \nfour")
    rows = logs.read_log_lines(spark, [str(folder)]).collect()
    assert sorted(r.raw_line for r in rows) == ["four", "one", "three", "two"]
    assert {r.source_log for r in rows} == {str(folder / "x.log")}


def test_label_map(spark, tmp_path):
    labels = spark.createDataFrame([(0, "Benign"), (1, "XSS"), (2, "CSRF")], "label_id LONG, label STRING")
    files.write_label_map(labels, str(tmp_path / "map"))
    assert [(r.label_id, r.label) for r in files.read_label_map(spark, str(tmp_path / "map")).collect()] == [(0, "Benign"), (2, "CSRF"), (1, "XSS")]


def test_metrics_text(spark):
    frame = spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("metrics"), F.lit(5).alias("plain"))
    assert files.metrics_text(frame).first().metrics == '{"a":1}'
    assert files.metrics_text(frame, "plain").first().plain == "5"


def segments(frame, parts=3):
    return jobs.Arrivals(frame.withColumn("part", F.floor(F.col("seq") * parts / frame.count()).cast("int")), "part", parts)


def events(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000 * (1 + F.col("id") % 3)).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 4 == 0, "b").otherwise("hot").alias("k"),
    )


@pytest.mark.parametrize("held", [10**6, 7])
def test_cooldown_of_a_stream_equals_the_batch(spark, held):
    """Rows of a key come in any order within a trigger; with 7 rows held, they pass through slices in the state store."""
    rows = events(spark).withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq") * 700_000).cast("timestamp_ntz"))
    arrivals = segments(rows.orderBy(F.xxhash64("seq")))
    streamed = jobs.drain(jobs.stream_cooldown(arrivals.stream(), ["k"], 20, held=held), "c", arrivals)
    assert {(r.k, r.seq) for r in streamed.collect()} == {(r.k, r.seq) for r in ordered.cooldown(rows, ["k"], 20).collect()}


@pytest.mark.parametrize("held", [10**6, 7])
def test_transitions_of_a_stream_equal_the_batch(spark, held):
    rows = spark.range(200).select(
        F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 100_000_000).cast("timestamp_ntz").alias("ts"), F.lit("vps").alias("hostname"),
        F.when(F.col("id") % 2 == 0, "CPU").otherwise("RAM").alias("metric"), (F.lit(70.0) + (F.col("id") * 37) % 30).alias("current_value"),
    )
    arrivals = segments(rows)
    streamed = jobs.drain(jobs.stream_metric_transitions(arrivals.stream(), held), "t", arrivals)
    batch = metrics.transitions(rows)
    assert {(r.seq, r.old_state, r.new_state) for r in streamed.collect()} == {(r.seq, r.old_state, r.new_state) for r in batch.collect()}


def test_state_of_a_key_goes_when_the_watermark_has_passed(spark):
    """With a delay a timer clears the state; a row after that starts a new chain, and an older one is dropped."""
    at = lambda s: START + timedelta(seconds=s)
    rows = spark.createDataFrame(
        [(0, at(0), "a", 0), (1, at(5), "a", 0), (2, at(500), "b", 0), (3, at(501), "b", 1), (4, at(2), "a", 2), (5, at(900), "a", 2)], "seq LONG, ts TIMESTAMP_NTZ, k STRING, part INT"
    )
    arrivals = jobs.Arrivals(rows, "part", 3)
    kept = jobs.drain(jobs.stream_cooldown(arrivals.stream(), ["k"], 20, delay="10 seconds"), "c", arrivals)
    assert sorted(r.seq for r in kept.collect()) == [0, 2, 5]


class Lost(Exception):
    pass


@pytest.mark.parametrize("lose,when", [(0, "after"), (1, "half"), (2, "before")])
def test_a_lost_driver_loses_and_doubles_nothing(spark, tmp_path, lose, when):
    """The driver goes before a batch is stored, when half of it is, or before it is committed; then it starts again."""
    rows = events(spark, 120).withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq") * 700_000).cast("timestamp_ntz"))
    place, arrivals, left = durable.Place(str(tmp_path), "kept"), segments(rows), {lose}

    def sink(batch, n):
        part = batch.limit(1) if n in left and when == "half" else batch
        if n not in left or when != "before":
            part.write.mode("overwrite").parquet(f"{place.data}/batch={n}")
        if n in left:
            left.remove(n)
            raise Lost

    def run():
        stream = jobs.stream_cooldown(arrivals.stream(), ["k"], 10)  # a new stream and session each time
        try:
            durable.start(stream, place, sink).awaitTermination()
        except StreamingQueryException:
            seen = durable.read(spark, place, durable.ddl(stream))
            assert durable.committed(spark, place) == lose - 1 and seen.where(F.col("batch") >= lose).count() == 0
            return run()
        return durable.read(spark, place, durable.ddl(stream))

    for _ in arrivals:
        found = run()
    assert sorted((r.k, r.seq) for r in found.collect()) == sorted((r.k, r.seq) for r in ordered.cooldown(rows, ["k"], 10).collect())


def test_a_stream_that_goes_on_takes_what_arrives(spark, tmp_path):
    rows = events(spark, 60)
    place, arrivals = durable.Place(str(tmp_path), "kept"), segments(rows)
    stream = arrivals.stream()
    query = durable.start(stream, place, every="200 milliseconds")
    try:
        for _ in arrivals:
            query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert sorted(r.seq for r in durable.read(spark, place, durable.ddl(stream)).collect()) == list(range(60))


def test_times_of_keys_are_those_of_earlier_batches(spark, tmp_path):
    times = durable.KeyedTimes(str(tmp_path), "k STRING", merge=3)
    row = lambda k, s: spark.createDataFrame([(k, START + timedelta(seconds=s))], "k STRING, ts TIMESTAMP_NTZ")
    seen = {}
    for n in range(11):
        key = ["a", "b", None][n % 3]
        for _ in range(2):  # a batch that runs again
            assert {r.k: r.ts for r in times.before(spark, n).collect()} == seen
            times.write(row(key, n), n)
        seen[key] = START + timedelta(seconds=n)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("batch=")]) <= 2 * 3 + 1


def test_live_floods_equal_the_batch(spark):
    """Reports and alerts of closed windows leave batch by batch and are those of the whole input."""
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("hostname"),
        F.lit("/var/log/nginx/access.log").alias("source_log"),
        F.format_string('10.0.0.%d - - [x] "GET /p%d HTTP/1.1" %d 5', F.floor(F.col("id") / 400) % 3, F.col("id") % 2, F.when(F.col("id") % 5 == 0, 500).otherwise(200)).alias("raw_line"),
    )
    rules = {"request_threshold": 50, "ip_threshold": 25, "endpoint_threshold": 60, "min_ips": 2}
    arrivals, place, sizes = segments(rows, 4), jobs.new_place(spark, "floods"), []
    for _ in arrivals:
        jobs.start_flood_alerts(arrivals.stream(**jobs.ONE_STATE), place, "1 minute", "30 seconds", "10 seconds", 60, 300, **rules).awaitTermination()
        sizes.append(files.read_table(spark, place.root, "alerts").count())
    assert sizes[0] > 0 and sizes[-1] > sizes[0]  # while rows still arrive
    counts = jobs.stream_traffic_counts(rows.withColumn("ts", F.col("ts")), "1 minute", "30 seconds", "10 seconds")
    wanted = jobs.traffic_by_window(counts, 60, **rules).withColumn("ts", (F.col("window_start") + F.expr("INTERVAL 60 SECONDS")).cast("timestamp_ntz"))
    last = START.fromtimestamp(1_700_000_000 + n - 1 - 10, tz=timezone.utc).replace(tzinfo=None)
    wanted = wanted.where(F.col("ts") <= F.lit(last)).withColumn("seq", F.unix_micros("window_start"))
    reports = spark.read.parquet(f"{place.root}/flood_reports")
    shape = ["hostname", "ts", "total_requests", "unique_ips", "top_ip", "top_ip_requests", "top_endpoint", "error_requests", "patterns_detected", "risk_level"]
    assert sorted(map(str, reports.select(*shape).collect())) == sorted(map(str, wanted.select(*shape).collect()))
    sent = ordered.cooldown(wanted.where("is_anomaly"), ["hostname", "top_ip"], 300)
    events = files.read_table(spark, place.root, "ddos_events")
    assert sorted((r.hostname, r.timestamp, r.top_ip, r.requests_count) for r in events.collect()) == sorted((r.hostname, r.ts, r.top_ip, r.total_requests) for r in sent.collect())


def keyword_scorer(frame):
    def load():
        return lambda texts: [("Cryptomining", 0.96) if "xmrig" in t else ("SSH_BruteForce", 0.5) for t in texts]

    scored = classify.udf_scorer(load)(F.col("clean_text"))
    return frame.withColumn("_p", scored).select(*frame.columns, F.col("_p.label").alias("prediction"), F.col("_p.confidence").alias("confidence"))


LINES = [
    "Aug 1 web systemd[1]: Started Session 1", "nothing", "Aug 04 14:31:00 web bash[1]: ./xmrig -o pool", "Aug 04 14:31:00 web sshd[1]: Failed password for root",
]


@pytest.fixture
def lines(spark):
    rows = [(i, START + timedelta(seconds=i), "vps", "/var/log/syslog", LINES[i % 4]) for i in range(40)]
    return spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, source_log STRING, raw_line STRING")


def test_triage_routes(spark, lines):
    one_pass = pipelines.stateless_triage(lines, keyword_scorer)
    two_pass = pipelines.triage_pipeline(lines, keyword_scorer)
    columns = ["seq", "route", "prediction", "risk", "status"]
    got = sorted(map(tuple, one_pass.select(*columns).collect()))
    assert got == sorted(map(tuple, two_pass.select(*columns).collect())) and len(got) == 40
    assert got[:4] == [(0, "BENIGN", None, None, None), (1, "NOISE", None, None, None), (2, "ALERT", "Cryptomining", "CRITICAL", "new"), (3, "LOG_ONLY", "SSH_BruteForce", "SAFE", "low_confidence")]


def test_multi_sink(spark, lines):
    def run(seconds):
        arrivals = segments(lines)
        return jobs.stream_multi_sink(arrivals.stream(), keyword_scorer, seconds, arrivals)

    for seconds, alerts in ((10, 4), (900, 1), (1, 10)):  # attacks are four seconds apart, and the cooldown spans batches
        counts = {r.table_name: (r.n, r.ids) for r in run(seconds).collect()}
        assert counts == {"security_decisions": (20, 20), "attack_logs": (20, 20), "alerts": (alerts, alerts)}


def test_cooldown_of_a_stream_keeps_late_rows_of_other_keys(spark):
    rows = spark.createDataFrame([(i, START + timedelta(seconds=100 * i), "a") for i in range(5)] + [(5, START, "b")], "seq LONG, ts TIMESTAMP_NTZ, k STRING")
    arrivals = segments(rows)
    kept = jobs.drain(jobs.stream_cooldown(arrivals.stream(), ["k"], 20), "c", arrivals)
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from hostvigil import session

    class Context:
        master, applicationId = "yarn", "app-1"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        session.work_root(Session())
    Context.master = "local[4]"
    assert session.work_root(Session()) == session.work_root(Session())


def test_counters_of_a_stream_equal_those_of_the_batch(spark, lines):
    arrivals = segments(lines)
    log = jobs.stream_counters(arrivals.stream(), keyword_scorer, jobs.new_place(spark, "counted"), arrivals)
    batch = pipelines.stateless_triage(lines, keyword_scorer).agg(*[c.alias(k) for k, c in incidents.counters().items()]).first().asDict()
    assert log.totals() == batch and len(log.by_batch) == 3


def test_ad_hoc_analysis_scores_what_triage_drops(spark, lines):
    rows = pipelines.analyze_on_demand(lines.where("seq < 4"), keyword_scorer).orderBy("seq").collect()
    assert [(r.seq, r.pre_decision, r.clean_text, r.decision) for r in rows[:2]] == [(0, "BENIGN", LINES[0], "LOG_ONLY"), (1, "PASS_TO_AI", "nothing", "LOG_ONLY")]
    assert (rows[2].stored_risk, rows[2].status, rows[2].risk_percentage) == ("CRITICAL", "manual_eval", 96.0)


def test_ad_hoc_analysis_with_best_labels_and_traffic(spark):
    web = '{} - - [08/Aug/2026:12:00:00 +0000] "GET /a HTTP/1.1" 500 10'
    texts = [web.format("1.2.3.4"), web.format("1.2.3.4"), "nothing", "  ", None]
    rows = [(i, START + timedelta(seconds=i), host, "access.log", text) for i, (host, text) in enumerate(zip(["vps", "vps", "vps", "vps", None], texts))]
    rows.append((5, START, None, "access.log", web.format("5.6.7.8")))
    frame = spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, source_log STRING, raw_line STRING")
    entry = lambda label, score: F.struct(F.lit(0.0).alias("rank"), F.lit(label).alias("label"), F.lit(score).alias("score"))
    ranked = lambda f: keyword_scorer(f).withColumn("scores", F.array(*[entry(*x) for x in (("a", 0.71239), ("b", 0.2), ("c", 0.08), ("d", 0.01))]))
    limits = {"seconds": 10, "request_threshold": 2, "ip_threshold": 2, "endpoint_threshold": 9, "min_ips": 2}
    found = {r.seq: r for r in pipelines.analyze_on_demand(frame, ranked, limits).collect()}
    assert sorted(found) == [0, 1, 2, 5]
    assert [tuple(x) for x in found[2].top3] == [("a", 0.7124), ("b", 0.2), ("c", 0.08)]
    assert found[2].ddos_analysis is None and not found[2].flood_dispatch
    assert [(found[i].ddos_analysis.total_requests, found[i].ddos_analysis.top_ip, found[i].flood_dispatch) for i in (0, 1, 5)] == [(1, "1.2.3.4", False), (2, "1.2.3.4", True), (1, "5.6.7.8", False)]


def test_ad_hoc_analysis_parses_the_stored_lines(spark, lines, monkeypatch):
    """Lines are read and shaped once, however many parts of the analysis need them."""
    parse, read = pipelines.triage.parse_access_log, []
    monkeypatch.setattr(pipelines.triage, "parse_access_log", lambda frame: parse(read.append(frame) or frame))
    pipelines.analyze_on_demand(lines, keyword_scorer, {"seconds": 10})
    assert len(read) == 1 and read[0].inputFiles() and all("/adhoc-" in name for name in read[0].inputFiles())


def test_ad_hoc_analysis_shapes_a_line_once(spark, lines, monkeypatch):
    """What makes a line is not copied into the patterns and filters that read it."""
    store, stored = pipelines.materialize, []
    monkeypatch.setattr(pipelines, "materialize", lambda frame, name: store(stored.append(frame) or frame, name))
    pipelines.analyze_on_demand(lines.withColumn("raw_line", F.reverse("raw_line")), keyword_scorer)
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1


def test_spread_leaves_large_input_alone(spark):
    assert logs.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 8
    wide = spark.range(10, numPartitions=20)
    assert logs.spread(wide) is wide


def test_a_segment_arrives_in_files_for_many_tasks(spark):
    rows = spark.range(1000, numPartitions=1).select(F.col("id").alias("seq"), F.floor(F.col("id") / 500).alias("segment"))
    arrivals = jobs.Arrivals(rows, "segment", 2, file_rows=20)
    for i in arrivals:
        found = spark.read.parquet(f"{arrivals.path}/{i}")
        assert len(found.inputFiles()) >= 25 and found.rdd.getNumPartitions() >= 8
        assert sorted(r.seq for r in found.collect()) == list(range(500 * i, 500 * i + 500))
    default = jobs.Arrivals(rows, "segment", 2)
    next(iter(default))
    assert len(spark.read.parquet(f"{default.path}/0").inputFiles()) == 8, "one file a core of a small input"


def test_streams_store_what_a_batch_changes(spark):
    conf = durable.stream_session(spark).conf
    name = "spark.sql.streaming.stateStore.rocksdb"
    assert conf.get(f"{name}.changelogCheckpointing.enabled") == "true" and conf.get(f"{name}.trackTotalNumberOfRows") == "false"
