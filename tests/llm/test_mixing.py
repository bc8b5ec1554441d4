import random
import re

import pytest
from pyspark.sql import functions as F

from hostvigil.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Size by source -> target, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - most * sum(sizes[s] for s in full)
        left = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in order}
        full |= above


def cases(seed=9):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["b", "b", "c", "Z", "é", "\U0001f600", "￮", None, "d", "e", "f"]
    return [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 50, 300]))) if rng.random() > 0.05 else None, None, rng.choice(sources)) for i in range(500)]


@pytest.mark.parametrize("buckets", [4, 1 << 16])
def test_targets_and_taken_words(make_docs, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "KEY_BUCKETS", buckets)
    rows = cases()
    found = mixing.mix(make_docs(rows)).collect()
    sizes, words = {}, {}
    for k, text, _, source in rows:
        words[k] = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + words[k]
    want, taken = plain_targets(sizes), {}
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for r in found:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        whole = min(3, int(want[r.source] // max(1, sizes[r.source])))
        assert whole * r.size <= r.taken <= min(3, whole + 1) * r.size
        taken.setdefault(r.source, []).append(r)
    for source, own in taken.items():
        assert abs(sum(r.taken for r in own) - want[source]) <= 1
        epochs = min(3, int(want[source] // max(1, sizes[source])))
        parts = [r for r in own if epochs * r.size < r.taken < (epochs + 1) * r.size]
        assert len(parts) <= 1


def test_selection_follows_the_sampling_order(spark, make_docs):
    docs = make_docs([(i, "w " * 10, None, "a" if i < 200 else "b") for i in range(400)])
    found = mixing.mix(docs)
    draw = F.pow(mixing.uniform(F.col("doc_id"), F.col("text"), 42), 1 / mixing.quality_weight(F.col("text"), F.col("size")))
    rows = found.where("source = 'b'").withColumn("draw", draw).orderBy(F.desc("draw")).collect()
    chosen = [r.taken > 0 for r in rows]
    assert chosen == sorted(chosen, reverse=True) and 0 < sum(chosen) < 200


def test_heavier_documents_are_taken_more_often(make_docs):
    docs = make_docs([(i, ("w" * (6 if i % 2 else 30) + " ") * 5, None, "a" if i % 4 < 2 else "b") for i in range(4000)])
    taken = mixing.mix(docs).where("source = 'b' and taken > 0").groupBy((F.col("doc_id") % 2).alias("heavy")).count().collect()
    counts = {r.heavy: r["count"] for r in taken}
    assert counts[1] > 1.3 * counts[0]


def test_reruns_agree_and_odd_rows(make_docs, odd_docs, no_docs):
    rows = cases(10)
    key = lambda f: sorted((r.doc_id, r.taken) for r in f.select("doc_id", "taken").collect())
    assert key(mixing.mix(make_docs(rows))) == key(mixing.mix(make_docs(rows[::-1]).repartition(7)))
    found = mixing.mix(odd_docs)
    assert found.count() == odd_docs.count() and found.where("taken > 3 * size or taken < 0").count() == 0
    assert set(found.columns) == {*odd_docs.columns, "source_size", "target", "taken"}
    assert mixing.mix(no_docs).count() == 0
    nothing = mixing.mix(make_docs([(1, None, None, "a"), (2, "", None, None)]))
    assert {r.taken for r in nothing.collect()} == {0}


def test_no_python_on_the_main_path(make_docs):
    plan = mixing.mix(make_docs(cases()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_stay(spark):
    names = ["_hv_size", "_hv_row", "_hv_draw", "doc", "key", "weight"]
    docs = spark.createDataFrame([(1, "one two", "a", *names), (2, "three", None, *names)], "doc_id LONG, text STRING, source STRING, " + ", ".join(f"{n} STRING" for n in names))
    found = mixing.mix(docs)
    assert found.columns == [*docs.columns, *mixing.OUTPUT]
    assert all([r[n] for n in names] == names for r in found.collect())
