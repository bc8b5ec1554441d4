import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from hostvigil.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target, buckets=10_000, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = [0] * buckets, [0] * buckets
    for _, text, *_ in rows:
        for f in features(text)[1]:
            corpus[bucket(f)] += 1
    for text in target:
        for f in features(text)[1]:
            wanted[bucket(f)] += 1
    s, t = sum(corpus), sum(wanted)
    out = []
    for i, (key, text, *_) in enumerate(rows):
        w, own = features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in map(bucket, own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), i])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def cases(seed=6, n=400):
    rng = random.Random(seed)
    vocabulary = ["The", "cat", "é", "漢字", "a1", "don't", "x-y", "Ünï", "z" * 700] + [f"w{i}" for i in range(80)]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(n)]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, "one two " * 15), (None, "one two " * 15), (9999, None)] + [(5, "same words here " * 9)] * 40


@pytest.fixture(scope="module")
def target(spark):
    texts = ["the cat a1 a1", "Cat é 漢字 w1 w2 w3", None, ""] * 3
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id LONG, text STRING, score STRING")


def test_equals_spelt_out_features(make_docs, target):
    found = importance.resample(make_docs(cases()), target[1])
    assert found.columns == ["doc_id", *importance.OUTPUT]
    assert sorted(map(tuple, found.collect()), key=str) == plain(cases(), target[0])


def test_small_slices_other_buckets_and_shares(make_docs, target, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_WORDS", 50)
    found = importance.resample(make_docs(cases()), target[1], buckets=97, percent=60)
    assert sorted(map(tuple, found.collect()), key=str) == plain(cases(), target[0], 97, 60)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_checksums_of_runs(longest):
    rng = random.Random(longest)
    words = [bytes(rng.choices(b"ab\xc3\xa9\xff", k=rng.choice([1, 2, 9, 5000]))) for _ in range(80)]
    for n, sums in enumerate(importance.gram_sums(words, longest), 1):
        assert sums.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    assert [s.tolist() for s in importance.gram_sums([b"one"], longest)] == [[zlib.crc32(b"one")]]


def test_zero_bytes_cancel():
    for length in (0, 1, 2, 255, 256, 70_000):
        for head in (b"", b"abc", "é漢".encode()):
            tail = bytes(random.Random(length).choices(range(256), k=length))
            moved = importance.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([length]))
            assert int(moved[0]) ^ zlib.crc32(head + tail) == zlib.crc32(tail)


def test_odd_rows(spark, odd_docs, no_docs, target):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = importance.resample(odd_docs, target[1], columns=tuple(odd_docs.columns))
    assert found.columns == [*[c for c in odd_docs.columns if c != "score"], *importance.OUTPUT]
    assert sorted(map(tuple, found.select("doc_id", *importance.OUTPUT).collect()), key=str) == plain(rows, target[0])
    none = target[1].limit(0)
    assert sorted(map(tuple, importance.resample(odd_docs, none).collect()), key=str) == plain(rows, [])
    assert importance.resample(no_docs, target[1]).count() == 0
    assert importance.resample(no_docs, none).count() == 0
