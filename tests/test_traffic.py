import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostvigil.operators import traffic

START = datetime(2026, 8, 8, 12, 0, 0)
SCHEMA = "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, ip STRING, endpoint STRING, method STRING, status LONG"


def frame(spark, rows):
    """rows: (seconds, ip, endpoint, status[, host])"""
    data = [(i, START + timedelta(seconds=s), (host or ["vps"])[0], ip, endpoint, "GET", status) for i, (s, ip, endpoint, status, *host) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def last(report):
    return report.orderBy(F.desc("ts"), F.desc("seq")).first()


def expected(rows, seconds, minute):
    """The plain loop over a list of (ts, seq, host, ip, endpoint, status) in order."""
    out = {}
    for i, (ts, seq, host, *_rest) in enumerate(rows):
        window = [r for r in rows[: i + 1] if r[2] == host and r[0] >= ts - timedelta(seconds=seconds)]
        recent = [r for r in rows[: i + 1] if r[2] == host and r[0] >= ts - timedelta(seconds=minute)]
        ips, endpoints = Counter(), Counter()
        for r in window:
            ips[r[3]] += 1
            endpoints[r[4]] += 1
        top_ip = max(ips.items(), key=lambda x: x[1])
        top_endpoint = max(endpoints.items(), key=lambda x: x[1])
        out[seq] = (len(window), len(recent), len(ips), *top_ip, *top_endpoint, sum(r[5] >= 400 for r in window))
    return out


def measured(report):
    return {
        r.seq: (r.total_requests, r.requests_per_minute, r.unique_ips, r.top_ip, r.top_ip_requests, r.top_endpoint, r.top_endpoint_requests, r.error_requests)
        for r in report.collect()
    }


@pytest.mark.parametrize("group_rows", [traffic.GROUP_ROWS, 60, 7, 1])
def test_same_as_a_plain_loop(spark, group_rows):
    """One host holds most requests; instants collide; hosts are split into up to 64 cells per window."""
    draw = random.Random(group_rows)
    rows = []
    for seq in range(600):
        host = "hot" if draw.random() < 0.8 else draw.choice("ab")
        at = START + timedelta(seconds=draw.choice([draw.randrange(0, 240), 60, 120]))
        rows.append((at, seq, host, f"ip{draw.randrange(6)}", f"/e{draw.randrange(3)}", draw.choice([200, 404, 500])))
    rows.sort(key=lambda r: (r[0], r[1]))
    data = spark.createDataFrame([(s, t, h, ip, e, "GET", st) for t, s, h, ip, e, st in rows], SCHEMA).repartition(5)
    report = traffic.traffic_report(data, seconds=10, group_rows=group_rows)
    wanted = expected(rows, 10, 60)
    assert measured(report) == wanted
    totals = traffic.traffic_totals(data, seconds=10, group_rows=group_rows)
    assert {r.seq: (r.total_requests, r.requests_per_minute, r.unique_ips, r.error_requests) for r in totals.collect()} == {k: (*v[:3], v[7]) for k, v in wanted.items()}
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_both_windows_of_a_host_are_one_scan(spark):
    """A request is shuffled once, and few are in two cells; Python stays the only step that orders them."""
    data = frame(spark, [(i, f"ip{i % 3}", "/", 200) for i in range(2400)])
    windows = traffic.traffic_windows(data, 60, 10)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and plan.count("MapInArrow") == 1 and "Window " not in plan
    assert {(r.seq, r.requests_per_minute, r.total_requests) for r in windows.collect()} == {(i, min(i, 10) + 1, min(i, 60) + 1) for i in range(2400)}


@pytest.mark.parametrize("seconds, minute, batch", [(10, 60, 7), (60, 10, 1), (30, 30, 1000)])
def test_a_scan_that_drops_what_has_left(monkeypatch, seconds, minute, batch):
    """Cells arrive in batches; places and names outside the window are dropped meanwhile."""
    monkeypatch.setattr(traffic, "TRIM_ROWS", 5)
    monkeypatch.setattr(traffic, "MAX_NAMES", 3)
    draw = random.Random(seconds)
    rows = sorted((START + timedelta(seconds=draw.randrange(600)), seq, draw.choice("ab"), f"ip{seq // 100}-{draw.randrange(4)}", draw.choice([None, "/x", "/y"]), draw.choice([200, 500])) for seq in range(800))
    reach = max(seconds, minute)
    length = reach * traffic.CELL_WINDOWS
    laid = []
    for ts, seq, host, ip, endpoint, status in rows:
        at = int((ts - START).total_seconds())
        laid.append((host, at // length, traffic._OWN, at * 1_000_000, seq, 1, ip, endpoint, int(status >= 400), {"seq": seq}))
        if at % length >= length - reach:
            laid.append((host, at // length + 1, traffic._BEFORE, at * 1_000_000, seq, 1, ip, endpoint, int(status >= 400), None))
    names = ["hostname", "cell", "role", "_us", "seq", "_n", "_ip", "_endpoint", "_error", "_row"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in sorted(laid, key=lambda r: r[:5])])
    found = {}
    for out in traffic._WindowScan(seconds * 1_000_000, minute * 1_000_000)(iter(table.to_batches(max_chunksize=batch))):
        for row, recent, total, ips, ip, ip_n, endpoint, endpoint_n, error in zip(*[c.to_pylist() for c in out.columns]):
            found[row["seq"]] = (total, recent, ips, ip, ip_n, endpoint, endpoint_n, error)
    assert found == expected(rows, seconds, minute)


def test_window_edge_is_inclusive_and_later_arrivals_do_not_count(spark):
    rows = [(0, "a", "/", 200), (10, "b", "/", 200), (10, "c", "/", 200), (10.000001, "d", "/", 200)]
    totals = {r.seq: r.total_requests for r in traffic.traffic_windows(frame(spark, rows)).collect()}
    assert totals == {0: 1, 1: 2, 2: 3, 3: 3}


def test_top_ip_tie_goes_to_the_first_seen(spark):
    rows = [(0, "z", "/", 200), (1, "a", "/", 200), (2, "a", "/", 200), (3, "z", "/", 200)]
    assert {r.seq: r.top_ip for r in traffic.traffic_windows(frame(spark, rows)).collect()} == {0: "z", 1: "z", 2: "a", 3: "z"}


def test_single_ip_flood(spark):
    one = traffic.traffic_report(frame(spark, [(0, "a", "/", 200)]), 5, 20, 10, 15)
    assert last(one).risk_level == "NORMAL"
    row = last(traffic.traffic_report(frame(spark, [(i / 100, "a", "/", 200) for i in range(12)]), 5, 20, 10, 15))
    assert row.risk_level == "HIGH" and row.patterns_detected == ["Single IP Flood (a sent 12 req/5s)"]


def test_distributed_flood(spark):
    row = last(traffic.traffic_report(frame(spark, [(i / 100, f"ip{i}", "/x", 200) for i in range(22)]), 5, 20, 10, 15))
    assert row.risk_level == "CRITICAL" and row.unique_ips == 22
    assert [x.split(" (")[0] for x in row.patterns_detected] == ["Distributed DDoS", "Targeted Endpoint Flood"]


def test_endpoint_flood(spark):
    row = last(traffic.traffic_report(frame(spark, [(i / 100, f"ip{i}", "/checkout", 200) for i in range(12)]), 5, 20, 50, 10))
    assert row.top_endpoint == "/checkout" and row.risk_level == "SUSPICIOUS" and not row.is_anomaly
    assert row.patterns_detected == ["Targeted Endpoint Flood (/checkout received 12 req/5s)"]


def test_sixty_requests_of_one_ip(spark):
    row = last(traffic.traffic_report(frame(spark, [(i / 10, "a", "/", 200) for i in range(60)])))
    assert row.risk_level == "HIGH" and row.is_anomaly


def test_error_rate_and_spike(spark):
    row = last(traffic.traffic_report(frame(spark, [(i / 100, f"ip{i % 9}", f"/{i % 50}", 500) for i in range(40)]), 10, 20, 50, 200))
    assert row.patterns_detected == ["Sudden Traffic Spike (40 req/10s)", "High HTTP Error Rate (40 error responses in window)"]
    assert row.risk_level == "CRITICAL"


def test_snapshot_is_the_report_without_a_new_request(spark):
    rows = frame(spark, [(0, "a", "/", 200), (55, "b", "/y", 500), (58, "a", "/y", 200), (59, "b", "/z", 200), (70, "late", "/", 200)])
    row = traffic.traffic_snapshot(rows, F.lit(START + timedelta(seconds=60)).cast("timestamp_ntz"), 10).first()
    assert (row.total_requests, row.requests_per_minute, row.unique_ips, row.top_ip, row.top_ip_requests) == (3, 4, 2, "b", 2)
    assert (row.top_endpoint, row.top_endpoint_requests, row.error_requests, row.risk_level) == ("/y", 2, 1, "NORMAL")
    quiet = traffic.traffic_snapshot(rows, F.lit(START + timedelta(seconds=50)).cast("timestamp_ntz"), 10).first()
    assert (quiet.total_requests, quiet.top_ip, quiet.requests_per_minute) == (0, "N/A", 1)


def test_a_hot_window_stays_linear(spark):
    """30,000 requests within one window; all pairs would be 450 million."""
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 100).cast("timestamp_ntz").alias("ts"), F.lit("vps").alias("hostname"),
        F.concat(F.lit("ip"), F.col("id") % 100).alias("ip"), F.lit("/x").alias("endpoint"), F.lit("GET").alias("method"), F.lit(200).cast("long").alias("status"),
    )
    row = traffic.traffic_windows(rows, group_rows=2000).agg(F.max("total_requests").alias("n"), F.max("unique_ips").alias("u"), F.max("top_ip_requests").alias("t"), F.count("*").alias("c")).first()
    assert tuple(row) == (n, 100, n // 100, n)
