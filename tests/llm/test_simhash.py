import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hostvigil.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    """values: (key, fingerprint) -> smallest key by index."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(values):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return [least[find(i)] for i in range(len(values))]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and len(set(masks)) == len(masks)
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & bits == 0 for m in masks)


def test_fingerprints_equal_the_plain_form():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 4, 50]:
        text = " ".join(rng.choice(["Alpha", "béta", "c", "D"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("A\x0bB\x1cÄ") == plain_fingerprint("a\x0bb\x1cÄ")


@pytest.mark.parametrize("block", [4, 256])
def test_components_equal_brute_force(spark, block):
    """Chains, a dense cluster that is larger than a block, and loners."""
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(120):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))))
    chain = rng.getrandbits(64)
    for i in range(0, 60, 3):
        chain ^= 7 << i
        values.add(chain)
    values = sorted(values)
    signed = [simhash.signed(v) for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp LONG"), block=block)
    for r in links.collect():
        assert (np.uint64(r.a % 2**64) ^ np.uint64(r.b % 2**64)).item().bit_count() <= 3
    found = {r.node: r.root for r in simhash.components(links).collect()}
    want = plain_components(list(zip(signed, values)))
    assert [found.get(v, v) for v in signed] == want


def test_isolated_pairs_link_wherever_they_differ():
    """Every two and every three of the 64 bits."""
    rng, forest = random.Random(4), simhash._BlockLinks(3, []).forest
    for n in (2, 3):
        for bits in itertools.combinations(range(64), n):
            a = rng.getrandbits(64)
            pair = [simhash.signed(v) for v in (a, a ^ sum(1 << b for b in bits))]
            assert [set(x) for x in forest(np.array(pair, dtype=np.int64))] == [set(pair)], bits
    far = [simhash.signed(v) for v in (1 << 63 | 1, 1 << 62 | 6)]
    assert forest(np.array(far, dtype=np.int64)) == []


def test_isolated_pairs_at_every_bit_are_components(spark):
    rng = random.Random(5)
    pairs = []
    for n in (2, 3):
        for bit in range(64):
            for with_top in (False, True):
                bits = {bit, 63} if with_top else {bit}
                while len(bits) < n:
                    bits.add(rng.randrange(64))
                a = rng.getrandbits(64)
                pairs.append(tuple(simhash.signed(v) for v in (a, a ^ sum(1 << b for b in bits))))
    links = simhash.links(spark.createDataFrame([(v,) for p in pairs for v in p], "fp LONG"))
    assert {tuple(sorted(r)) for r in links.collect()} == {tuple(sorted(p)) for p in pairs}


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(300)] + [(50, 400)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(path + star + path, "a LONG, b LONG")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 50 for i in [50, *range(100, 401)]}}


def test_documents(make_docs, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    values = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    want = sorted((k or 0, f"{v:016x}", c or 0) for (k, v), c in zip(values, plain_components(values)))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in rows) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert simhash.keep_one_each(no_docs).count() == 0


def test_large_groups_of_copies(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(80))
    docs = make_docs([(i, text if i % 3 else text + f" tail{i}") for i in range(600)])
    rows = simhash.near_duplicates(docs)
    values = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").distinct().collect()]
    want = dict(zip([k for k, _ in values], plain_components(values)))
    assert {r.doc_id: r.component_id for r in rows.collect()} == want
    assert rows.agg(F.count("*")).first()[0] == 600
