import math
import random
import re

import pytest

from hostvigil.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def starts(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def plain(text, idf, slack=licenses.SLACK, coverage=licenses.COVERAGE, rare=licenses.RARE):
    """The scan by loops over all places of all templates."""
    words = split(text)
    base = [(p, label) for phrase, label in licenses.BASE_PHRASES.items() for p in starts(words, split(phrase))]
    labels, score = {label for _, label in base}, 0.5 if base else 0.0
    for template in licenses.TEMPLATES:
        own = split(template.text)
        chosen = sorted({w for w in own if w in words}, key=lambda w: (-idf[w], w.encode()))[:rare]
        begins = {i - q for i, w in enumerate(words) if w in chosen for q, x in enumerate(own) if x == w}
        for at in begins:
            there = lambda places, q: any(abs(p - at - q) <= slack for p in places)
            places = {w: [i for i, x in enumerate(words) if x == w] for w in set(own)}
            votes = sum(any(there(places[w], q) for q, x in enumerate(own) if x == w) for w in chosen)
            phrases = all(any(there(starts(words, split(p)), q) for q in starts(own, split(p))) for p in template.phrases)
            share = sum(there(places[w], q) for q, w in enumerate(own)) / len(own)
            if 2 * votes >= len(chosen) and phrases and share >= coverage:
                labels.add(template.label)
                score = max(score, share)
    at = [p for p, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def cases(seed=5, n=150):
    rng = random.Random(seed)
    loose = [w for t in licenses.TEMPLATES for w in split(t.text)]
    rows = []
    for i in range(n):
        words = rng.choices(["lorem", "ipsum", "the", "of", "und", "é"], k=rng.choice([0, 3, 40])) + rng.choices(loose, k=rng.choice([0, 10]))
        if rng.random() < 0.7:
            copy = split(rng.choice(licenses.TEMPLATES).text)
            for _ in range(rng.choice([0, 1, 3])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = rng.choices(["acme", "2024", "the"], k=rng.choice([0, 1, 2]))
                copy = copy or ["x"]
            at = rng.randint(0, len(words))
            words[at:at] = copy
        text = rng.choice([" ", "-", "\n"]).join(words)
        rows.append((i, text.title() if rng.random() < 0.2 else text))
    return rows + [(900, None), (901, "CC-BY cc by,cc by"), (902, "all rights reserved all rights reserved")]


def test_equals_a_plain_scan(make_docs):
    docs = make_docs(cases())
    idf = licenses.inverse_frequencies(docs)
    found = {r.doc_id: tuple(r[c] for c in licenses.OUTPUT) for r in licenses.scan_licenses(docs).collect()}
    for key, text in cases():
        want = plain(text, idf)
        assert found[key][:6] == want[:6] and abs(found[key][6] - want[6]) < 1e-12, text
    assert len({labels for *_, labels, _ in found.values()}) > 10


def test_frequencies_count_every_document(make_docs):
    rows = [(i, "the license" if i % 2 else None) for i in range(60)]
    idf = licenses.inverse_frequencies(make_docs(rows))
    assert idf["license"] == pytest.approx(math.log(61 / 31)) and idf["mozilla"] == pytest.approx(math.log(61))


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.text[:30])
def test_every_template_is_found_in_a_long_text_with_small_changes(template):
    index = licenses.LicenseIndex(licenses.TEMPLATES, {}, licenses.BASE_PHRASES)
    filler = "Copyright 2024 by the author of this file. " * 40
    *_, labels, score = index.scan(f"{filler}\n# {template.text}\n{filler}")
    assert template.label in labels.split(",") and score == 1.0
    assert index.scan(filler)[5:] == ("", 0.0)


def test_phrases_are_mandatory():
    index = licenses.LicenseIndex(licenses.TEMPLATES, {}, licenses.BASE_PHRASES)
    assert index.scan("Released under the TIM License")[5] == ""
    assert index.scan("license mit the under released")[5] == ""
    assert index.scan("mit license")[5] == ""  # the phrase alone is too small a part
    with pytest.raises(ValueError):
        licenses.LicenseIndex((licenses.Template("x", "one two", ("two one",)),), {}, {})


def test_odd_rows(odd_docs, no_docs):
    found = licenses.scan_licenses(odd_docs)
    assert found.columns == [c for c in odd_docs.columns if c != "score"] + list(licenses.OUTPUT)
    assert sorted(r.n_words for r in found.collect()) == sorted(len(split(r.text)) for r in odd_docs.collect())
    assert licenses.scan_licenses(no_docs).count() == 0


def test_very_many_places_take_linear_time():
    index = licenses.LicenseIndex(licenses.TEMPLATES, {}, licenses.BASE_PHRASES)
    n, places, *_ = index.scan("released under the mit license all rights reserved " * 40_000)
    assert (n, places) == (320_000, 40_000)
