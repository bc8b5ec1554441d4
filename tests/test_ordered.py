import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostvigil.operators import ordered

START = datetime(2026, 1, 1)


def series(spark, rows):
    """rows: (key, seconds)"""
    return spark.createDataFrame([(k, START + timedelta(seconds=s), i) for i, (k, s) in enumerate(rows)], "k STRING, ts TIMESTAMP_NTZ, seq LONG")


def greedy(rows, seconds):
    kept, last = [], {}
    for seq, (k, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if k not in last or s - last[k] >= seconds:
            last[k] = s
            kept.append(seq)
    return sorted(kept)


@pytest.mark.parametrize("spans", [1, 2, 8, 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_equals_the_plain_loop(spark, spans, seed):
    """One key holds most rows, with gaps, dense runs and equal instants; a NULL key counts as a key."""
    draw = random.Random(seed)
    rows = []
    for _ in range(3000):
        key = "hot" if draw.random() < 0.7 else draw.choice(["a", "b", None])
        rows.append((key, round(draw.choice([draw.uniform(0, 4000), draw.uniform(9000, 9100), 500.0]), draw.choice([0, 3, 6]))))
    got = ordered.cooldown(series(spark, rows).repartition(6), ["k"], 60, spans=spans)
    assert sorted(r.seq for r in got.collect()) == greedy(rows, 60)


def test_cooldown_edges(spark):
    rows = [("a", 0), ("a", 0), ("a", 2.999999), ("a", 3), ("a", 5.9), ("b", 1), ("a", 6)]
    assert sorted(r.seq for r in ordered.cooldown(series(spark, rows), ["k"], 3).collect()) == [0, 3, 5, 6]


def test_suppressed_rows_do_not_extend_a_cooldown(spark):
    rows = [("a", s) for s in range(0, 31)]
    assert sorted(r.seq for r in ordered.cooldown(series(spark, rows), ["k"], 10).collect()) == [0, 10, 20, 30]


def test_cooldown_of_a_dense_key_in_small_batches(spark):
    """One key holds all rows; a chunk arrives in several batches."""
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 5_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7000)
    try:
        kept = ordered.cooldown(rows, ["k"], 100, spans=3)
        assert [r.seq for r in kept.orderBy("seq").collect()] == list(range(0, 200_000, 20_000))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chains_of_a_chunk_meet():
    import numpy as np

    scan = ordered._EntryScan(["k", "_chunk"], 100, 8)
    us = np.arange(0, 800, 7)
    state = (np.empty(0, np.int64), np.empty(0, np.int64))
    for part in np.array_split(us, 5):
        state = scan.grow(state, ("a", 0), part)
    for due in range(0, 100):
        last, want = None, due
        for t in us:
            if t >= want:
                last, want = t, t + 100
        at = state[0].searchsorted(due)
        assert state[1][at] == last + 100
    sparse = scan.grow((np.empty(0, np.int64), np.empty(0, np.int64)), ("a", 0), np.array([5, 50, 130, 160, 700]))
    assert list(sparse[1]) == [800]


def test_cooldown_keeps_all_columns(spark):
    rows = series(spark, [("a", 0), ("a", 100)]).withColumn("extra", F.array(F.struct("seq", "k")))
    got = ordered.cooldown(rows, ["k"], 10)
    assert got.columns == rows.columns and got.count() == 2 and got.first().extra[0].k == "a"


@pytest.mark.parametrize("chunk", [1, 30, 86_400])
def test_previous_and_next_cross_chunks(spark, chunk):
    draw = random.Random(chunk)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.randrange(0, 300)) for _ in range(400)]
    frame = series(spark, rows).withColumn("v", F.when(F.col("seq") % 3 == 0, F.col("seq"))).withColumn("w", F.col("seq").cast("string")).repartition(5)
    got = ordered.with_next(ordered.with_previous(frame, ["k"], "w", "before", "none", chunk), ["k"], "v", "after", chunk).collect()
    expected = {}
    for key in {k for k, _ in rows}:
        line = [seq for seq, (k, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])) if k == key]
        for i, seq in enumerate(line):
            expected[seq] = (str(line[i - 1]) if i else "none", next((x for x in line[i + 1 :] if x % 3 == 0), None))
    assert {r.seq: (r.before, r.after) for r in got} == expected


def test_rank_by_buckets(spark):
    frame = spark.range(2000).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("o"))
    bucket = F.conv(F.substring("o", 1, 2), 16, 10).cast("int")
    rows = ordered.with_rank(frame, ["k"], "o", bucket, "r").collect()
    for key in range(3):
        group = sorted([r for r in rows if r.k == key], key=lambda r: r.o)
        assert [r.r for r in group] == list(range(1, len(group) + 1)) and {r.r_of for r in group} == {len(group)}
