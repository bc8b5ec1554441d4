import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostvigil.llm import language
from hostvigil.llm.common import fold_of

SYLLABLES = {"en": ["the", "ing", "th", "er", "and"], "de": ["ung", "sch", "ein", "ü", "der"], "fr": ["eau", "eux", "ê", "que", "ai"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, text(rng, lang, rng.choice([8, 40, 200])), lang, None) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(make_docs, rows):
    docs = make_docs(rows)
    held = fold_of(F.col("doc_id"), 5) == 0
    model = language.train(docs.where(~held))
    assert model.names == sorted(SYLLABLES)
    found = language.identify(docs.where(held), model).collect()
    assert len(found) > 30 and np.mean([r.lang == r.lang_pred for r in found]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_mixtures_are_found(make_docs, rows):
    model = language.train(make_docs(rows))
    rng = random.Random(2)
    both = text(rng, "en", 140) + " " + text(rng, "fr", 60)
    lang, share, chosen, shares = language.infer(both, model)
    assert lang == "en" and set(chosen) == {"en", "fr"} and 0.5 < share < 0.9
    assert abs(sum(shares) - 1) < 1e-6
    assert language.infer(text(rng, "de", 100), model)[2] == ["de"]


def plain_mixture(likelihood, counts):
    """EM by loops: likelihood[gram][language], counts[gram]."""
    k, total = len(next(iter(likelihood.values()))), sum(counts.values())
    share = [1.0 / k] * k
    for _ in range(language.STEPS):
        following = [0.0] * k
        for gram, n in counts.items():
            mixed = sum(share[j] * likelihood[gram][j] for j in range(k))
            for j in range(k):
                following[j] += n * share[j] * likelihood[gram][j] / mixed / total
        moved = max(abs(x - y) for x, y in zip(share, following))
        share = following
        if moved < 1e-3:
            break
    return share, sum(n * math.log(sum(share[j] * likelihood[g][j] for j in range(k))) for g, n in counts.items())


def plain_answer(text, rows):
    """Counts, smoothing, EM over all languages, and the set by penalised likelihood, from the rows themselves."""
    seen, names = defaultdict(Counter), sorted({lang for _, _, lang, _ in rows})
    for _, body, lang, _ in rows:
        seen[lang].update(language.grams(body).tolist())
    size = {x: sum(seen[x].values()) + language.SMOOTHING * language.BUCKETS for x in names}
    counts = Counter(language.grams(text).tolist())
    likelihood = {g: [(seen[x][g] + language.SMOOTHING) / size[x] for x in names] for g in counts}
    likelihood = {g: [x / max(v) for x in v] for g, v in likelihood.items()}
    share, _ = plain_mixture(likelihood, counts)
    order = sorted(range(len(names)), key=lambda j: (-share[j], j))
    cost, best, kept = language.PENALTY * math.log(max(2, sum(counts.values()))), -math.inf, None
    for n in range(1, len(names) + 1):
        part = order[:n]
        part_share, fit = plain_mixture({g: [v[j] for j in part] for g, v in likelihood.items()}, counts)
        if fit - cost * n <= best:
            break
        best, kept = fit - cost * n, (part, part_share)
    part, part_share = kept
    first = part[part_share.index(max(part_share))]
    return names[first], share[first], [names[j] for j in part], part_share


def test_same_as_plain_counts_mixture_and_set_search(make_docs, rows):
    """Short, long and mixed texts of the operator against loops that share only the gram buckets."""
    rng = random.Random(5)
    texts = [text(rng, rng.choice(list(SYLLABLES)), n) for n in (1, 3, 10, 60, 200)]
    texts += [" ".join(text(rng, lang, n) for lang, n in mix) for mix in ([("en", 60), ("de", 50)], [("fr", 80), ("de", 40), ("en", 40)], [("de", 100), ("fr", 4)])]
    asked = make_docs([(i, body, None, None) for i, body in enumerate(texts)])
    found = {r.doc_id: r for r in language.identify(asked, language.train(make_docs(rows))).collect()}
    for i, body in enumerate(texts):
        lang, score, chosen, shares = plain_answer(body, rows)
        assert (found[i].lang_pred, found[i].languages) == (lang, chosen)
        assert abs(found[i].score - score) < 1e-3 and np.allclose(found[i].proportions, shares, atol=1e-3)
    assert max(len(r.languages) for r in found.values()) >= 2


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(0)
    likelihood, weight = rng.random((50, 3)) + 0.01, rng.integers(1, 5, 50)
    fits = [language.proportions(likelihood, weight, steps)[1] for steps in (1, 3, 10, 100)]
    assert all(b >= a - 1e-9 for a, b in zip(fits, fits[1:]))


def test_odd_rows(make_docs, odd_docs, no_docs, rows):
    model = language.train(make_docs(rows))
    found = {r.doc_id: r for r in language.identify(odd_docs, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0.0
    assert found[7].lang_pred in model.names
    assert language.identify(no_docs, model).count() == 0
    nothing = language.train(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}
