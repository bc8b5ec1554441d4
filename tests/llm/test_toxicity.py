import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostvigil.llm import toxicity
from hostvigil.llm.common import fold_of

BAD = ["snargle", "blorptwit", "vexgrub"]


def rows(seed=1, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([30, 120]))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                word = rng.choice(BAD)
                word = {0: word, 1: word.upper() + "!", 2: word + "ing", 3: word.replace("a", "4").replace("o", "0"), 4: word.replace("e", "е").replace("o", "ο")}[rng.randrange(5)]
                words[rng.randrange(len(words))] = word
        elif rng.random() < 0.2:
            words[5:7] = ["garden", "vexgrub"]
        out.append((i, " ".join(words), None, None, int(bad)))
    return out


@pytest.fixture(scope="module")
def lexicon(spark, make_docs):
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows()] + [(None, 1), (2, None)], "doc_id LONG, toxic INT")
    return toxicity.train(make_docs(rows()), labels, fold_of(F.col("key"), 3) != 1)


def test_held_out_accuracy(make_docs, lexicon):
    docs = make_docs(rows())
    found = toxicity.score(docs, lexicon).where(fold_of(F.col("doc_id"), 3) == 1).collect()
    truth = {r[0]: r[4] for r in rows()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_disguised_words_and_exceptions(lexicon):
    matcher = toxicity.Matcher(lexicon)
    text = "one two three {} four five"
    for word in ["snargle", "SNARGLE!!", "sn4rgle", "ѕnаrglе", "ｓｎａｒｇｌｅ", "sn­argle", "snargles"]:
        assert matcher.features(text.format(word))[3] == 1, word
    for word in ["nargle", "48 915", "snar gle", "thesnargle", ""]:
        assert matcher.features(text.format(word))[3] == 0, word
    assert " garden vexgrub " in lexicon.phrases
    assert matcher.features("a garden vexgrub b")[3] == 0 and matcher.features("a vexgrub b")[3] == 1


def test_matches_equal_a_plain_search(lexicon):
    matcher = toxicity.Matcher(lexicon)
    for _, text, *_ in rows(5, 60):
        folded = toxicity.fold(text)
        found = {}
        for at in range(len(folded)):
            own = [w for t, w in lexicon.terms.items() if folded.startswith(t, at)]
            inside = any(p for p in lexicon.phrases for s in range(len(folded)) if folded.startswith(p, s) and s <= at < s + len(p) - 1)
            if own and not inside:
                found[at] = max(own)
        assert {s: w for s, _, w in matcher.hits(folded)} == found


def test_substitutions_anywhere_in_a_word():
    for text, folded in [("a55", " ass "), ("A$$!", " ass "), ("b00000b", " booooob "), ("5n4rgl3", " snargle "), ("48 915 $5", "  "), ("x12", " x "), ("a55 48", " ass ")]:
        assert toxicity.fold(text) == folded, text


def test_stems_by_what_they_cover():
    word, stem = (" snargle ", 4.0, 9, 0), lambda n, toxic=12, clean=0: (" snargle"[: n + 1], 4.0, toxic, clean)
    assert set(toxicity.without_covered([word, stem(4), stem(5), stem(6), stem(7)])) == {" snargle"}
    other = (" snarl ", 4.0, 2, 0)
    assert set(toxicity.without_covered([word, other, stem(4, 14), stem(5), stem(7)])) == {" snar"}  # covers both words
    assert set(toxicity.without_covered([word, (" snar", 2.0, 14, 3), stem(7)])) == {" snar", " snargle"}  # weighs less
    many = [(f" word{i:05d} ", 3.0, 5, 0) for i in range(30_000)]
    assert len(toxicity.without_covered(many)) == 30_000


def test_very_many_hits_take_linear_time():
    lexicon = toxicity.Lexicon({" snargle ": 3.0, " vexgrub": 2.0}, frozenset({" garden vexgrub ", " snargle snargle "}))
    matcher = toxicity.Matcher(lexicon)
    start = time.monotonic()
    assert len(matcher.hits(toxicity.fold("garden vexgrub " * 100_000))) == 0
    assert len(matcher.hits(toxicity.fold("vexgrub garden vexgrub " * 50_000))) == 50_000
    assert time.monotonic() - start < 2


def test_longer_texts_weigh_a_word_less(lexicon):
    matcher = toxicity.Matcher(lexicon)
    scores = [matcher.features("snargle " + "abc " * n)[0] for n in (1, 100, 10_000)]
    assert scores[0] > scores[1] > scores[2] > 0


def test_odd_rows(spark, odd_docs, no_docs, lexicon):
    scored = toxicity.score(odd_docs, lexicon)
    found = scored.collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in found)
    assert toxicity.score(no_docs, lexicon).count() == 0
    none = spark.createDataFrame([], "doc_id LONG, toxic INT")
    empty = toxicity.train(odd_docs, none, F.lit(True))
    assert not empty.terms and toxicity.score(odd_docs, empty).count() == odd_docs.count()
