import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostvigil.llm import quality
from hostvigil.llm.common import fold_of


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([20, 100, 400]))]
        good = rng.random() < 0.7
        out.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), None, None, int(good)))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], r[4]) for r in rows()] + [(None, 1), (3, None), (5, rows()[5][4])], "doc_id LONG, quality INT")


def test_held_out_accuracy(make_docs, labels):
    docs = make_docs(rows())
    net = quality.train(docs, labels, fold_of(F.col("key"), 5) != 0)
    found = quality.score(docs, net).where(fold_of(F.col("doc_id"), 5) == 0).collect()
    truth = {r[0]: r[4] for r in rows()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def plain_score(net, text):
    """The score by loops over all windows of all chunks, at every byte offset."""
    data = text.encode()
    starts = range(0, max(1, len(data) - quality.WIDTH), quality.STEP)
    weights = net.filters.reshape(quality.WIDTH, quality.EMBED, quality.FILTERS)
    best = []
    for start in starts:
        seen = np.frombuffer(data[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
        found = [np.einsum("we,wef->f", net.embed[seen[o : o + quality.WIDTH]], weights) for o in range(quality.CHUNK - quality.WIDTH + 1)]
        best.append(np.maximum(np.max(found, axis=0) + net.bias, 0))
    features = np.concatenate([np.max(best, axis=0), np.mean(best, axis=0)])
    inner = np.maximum(features @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-(inner @ net.out + net.out_bias[0])))


def test_score_equals_a_plain_form_at_every_offset():
    net = quality.ByteNet.start()
    for p in net.parameters():
        p += np.random.default_rng(1).standard_normal(p.shape).astype(np.float32) * 0.1
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcdé ,漢") for _ in range(n)) for n in (0, 1, 15, 16, 17, 239, 256, 257, 700, 1503)]
    for text in [*texts, "x" * 300 + "MARK" + "y" * 301, "x" * 301 + "MARK" + "y" * 300]:
        assert abs(net.score(text) - plain_score(net, text)) < 1e-4, len(text)


def test_every_part_of_a_text_counts():
    text = "".join(random.Random(0).choice("abcd ") for _ in range(20_000))
    chunks = quality.chunks_of(text)
    assert b"".join(c[: quality.STEP].tobytes() for c in chunks[:-1]) == text.encode()[: quality.STEP * (len(chunks) - 1)]
    for n in (0, 1, 15, 16, 17, 256, 257, 496, 497):
        assert quality.chunks_of("a" * n)[-1].tobytes().rstrip(b"\0").endswith(b"a" * min(n, 1))


def test_gradients_equal_differences():
    net = quality.ByteNet.start(3)
    for p in net.parameters():
        p += np.random.default_rng(1).standard_normal(p.shape).astype(np.float32) * 0.05
    docs = [quality.chunks_of(t) for t in ("abc def ghi " * 40, "XY!! " * 30, "q")]
    truth = np.array([1, 0, 1], np.float32)

    def loss():
        score = np.array([net.score(t) for t in ("abc def ghi " * 40, "XY!! " * 30, "q")])
        return float(-np.mean(truth * np.log(score) + (1 - truth) * np.log(1 - score)))

    grads = quality._gradients(net, docs, truth)
    rng = np.random.default_rng(2)
    for p, g in zip(net.parameters(), grads):
        big = np.argsort(-np.abs(g).ravel())[:3]
        for i in [*big, rng.integers(p.size)]:
            old, h = p.ravel()[i].item(), 2e-3
            p.ravel()[i] = old + h
            up = loss()
            p.ravel()[i] = old - h
            down = loss()
            p.ravel()[i] = old
            assert abs((up - down) / (2 * h) - g.ravel()[i]) < 2e-3 + 0.05 * abs(g.ravel()[i])


def test_odd_rows(spark, make_docs, odd_docs, no_docs, labels):
    net = quality.train(make_docs(rows()), labels, F.lit(True))
    scored = quality.score(odd_docs, net)
    assert scored.columns == [c for c in odd_docs.columns if c != "score"] + ["score", "predicted"]
    found = scored.collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert quality.score(no_docs, net).count() == 0
    nothing = quality.train(no_docs, labels, F.lit(True))
    assert {round(r.score, 6) for r in quality.score(odd_docs, nothing).collect()} == {0.5}
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert quality.score(odd_docs, quality.train(odd_docs, none, F.lit(True))).count() == odd_docs.count()


def test_the_sample_is_bounded(make_docs, labels):
    found = quality.labelled_sample(make_docs(rows()), labels, "quality", F.lit(True), rows=50, size=20_000)
    texts = [r.text for r in found.collect()]
    assert 0 < len(texts) <= 50 and sum(map(len, texts)) <= 20_000


@pytest.mark.parametrize("long", [300_000, 150_000])
def test_one_long_text_does_not_end_the_sample(spark, make_docs, labels, long):
    """The first labelled text in sample order is above the bound, or takes most of it."""
    first = spark.range(400).orderBy(F.xxhash64(F.col("id").cast("string")), "id").first()[0]
    docs = make_docs([(r[0], "x" * long if r[0] == first else r[1]) for r in rows()])
    found = quality.labelled_sample(docs, labels, "quality", F.lit(True), size=200_000).collect()
    assert len(found) > 100 and {r.label for r in found} == {0, 1} and sum(len(r.text) for r in found) <= 200_000
    assert str(first) not in {r.key for r in found}


def test_a_lost_class_is_reported(make_docs, labels):
    docs = make_docs([(r[0], r[1] if r[4] else "x" * 30_000) for r in rows(n=30)])
    with pytest.raises(ValueError, match="quality <= 0"):
        quality.labelled_sample(docs, labels, "quality", F.lit(True), size=20_000)
    with pytest.warns(RuntimeWarning, match="quality <= 0"):
        quality.labelled_sample(make_docs([r for r in rows() if r[4]]), labels, "quality", F.lit(True))
