"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.llm.common import named, text_function, without
from hostvigil.llm.quality import labelled_sample

TRAIN_ROWS, TRAIN_BYTES = 20_000, 100_000_000
STEM, LEAST_DOCS, LEAST_ODDS = (4, 12), 4, 2.0
THRESHOLD = 0.7
OUTPUT = ("score", "predicted", "weight", "matches")

# Look-alike letters of other scripts, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms of ASCII
_FOLD_LETTERS = str.maketrans({**HOMOGLYPHS, **_WIDE, "\u00ad": None, "\u200b": None, "\u200c": None, "\u200d": None})
# Digits and signs that stand for letters: a run of them beside a letter, with no other digit in between, so a number
# stays no word.
_SPELT = re.compile(r"(?<=[^\W\d_])[01345789@$]+(?!\d)|(?<![\d@$])[01345789@$]+(?=[^\W\d_])")
_DIGITS = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Words of letters between single spaces, lower case, look-alikes and digit spellings undone.

    A sign or digit stands for a letter only in a run that touches a letter.
    """
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD_LETTERS)
    if _SPELT.search(low):
        low = _SPELT.sub(lambda m: m[0].translate(_DIGITS), low)
    return " " + " ".join(_WORD.findall(low)) + " "



@dataclass
class Lexicon:
    """Terms (whole words as ' word ', stems as ' stem') with weights, phrases that are let pass, and a calibration."""

    terms: dict[str, float] = field(default_factory=dict)
    phrases: frozenset[str] = frozenset()
    calibration: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0)

    def parts(self) -> tuple:
        return self.terms, self.phrases, self.calibration


class Matcher:
    """One automaton for the terms and one for exception phrases, over folded text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.terms, self.passed = self._automaton(lexicon.terms), self._automaton(dict.fromkeys(lexicon.phrases, 0.0))

    @staticmethod
    def _automaton(terms: dict[str, float]):
        machine = ahocorasick.Automaton()
        for term, weight in terms.items():
            machine.add_word(term, (len(term), weight))
        if terms:
            machine.make_automaton()
        return machine if terms else None

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words hit, each with its heaviest term, those inside exception phrases left out."""
        if self.terms is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        for end, (n, weight) in self.terms.iter(folded):
            start = end + 1 - n
            if start not in best or weight > best[start][1]:
                best[start] = (end + 1, weight)
        return self.outside([(start, end, weight) for start, (end, weight) in sorted(best.items())], folded)

    def outside(self, hits: list[tuple], folded: str) -> list[tuple]:
        """Those of the hits, sorted by start, that begin in no exception phrase."""
        if not hits or self.passed is None:
            return hits
        kept, upto, at = [], 0, 0  # both lists run by start; upto is the furthest end of the phrases begun so far
        passed = sorted((end + 1 - n, end) for end, (n, _) in self.passed.iter(folded))
        for hit in hits:
            while at < len(passed) and passed[at][0] <= hit[0]:
                upto = max(upto, passed[at][1])
                at += 1
            if hit[0] >= upto:
                kept.append(hit)
        return kept

    def terms_outside(self, folded: str) -> set[str]:
        """All terms with a hit outside exception phrases."""
        if self.terms is None:
            return set()
        every = sorted((end + 1 - n, folded[end + 1 - n : end + 1]) for end, (n, _) in self.terms.iter(folded))
        return {term for _, term in self.outside(every, folded)}

    def features(self, text: str) -> tuple[float, float, float, int]:
        """Weight normalised by length, weight in all, heaviest term, number of words hit."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0, 0.0, 0
        total = sum(w for _, _, w in found)
        words = folded.count(" ") - 1
        return 100 * total / (words + 50), total, max(w for _, _, w in found), len(found)

    def score(self, text: str) -> tuple[float, float, int]:
        density, total, most, n = self.features(text)
        bias, *slopes = self.lexicon.calibration
        z = bias + sum(s * x for s, x in zip(slopes, squash(density, total, most)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), total, n


def squash(density: float, total: float, most: float) -> tuple[float, float, float]:
    return math.log1p(density), math.log1p(total), most


def candidate_terms(folded: str, stem: tuple[int, int] = STEM) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        out.update(f" {w[:n]}" for n in range(stem[0], min(stem[1], len(w)) + 1))
    return out


class _TermCounts:
    """Documents with each candidate term, per label: partial counts of one task, as rows (term, toxic, clean)."""

    def __init__(self, make: Callable[[str], set[str]], held: int = 400_000):
        self.make, self.held = make, held

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                for term in self.make(fold(text.as_py())):
                    counts.setdefault(term, [0, 0])[0 if label else 1] += 1
                if len(counts) > self.held:
                    yield self.rows(counts)
                    counts = {}
        yield self.rows(counts)

    @staticmethod
    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        values = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["term", "toxic", "clean"])


class _OverLexicon:
    """A function of folded text that needs a matcher, which each task builds once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __getstate__(self):
        return {"lexicon": self.lexicon}

    def __call__(self, folded: str) -> set[str]:
        if not hasattr(self, "matcher"):
            self.matcher = Matcher(self.lexicon)
        return self.found(folded)


class _Phrases(_OverLexicon):
    """Word pairs that hold a lexicon hit, with a space on both sides."""

    def found(self, folded: str) -> set[str]:
        found = set()
        for start, _, _ in self.matcher.hits(folded):
            end = folded.index(" ", start + 1)
            if start:
                found.add(folded[folded.rindex(" ", 0, start) : end + 1])
            if end + 1 < len(folded):
                found.add(folded[start : folded.index(" ", end + 1) + 1])
        return found


class _Outside(_OverLexicon):
    """Terms that occur outside exception phrases."""

    def found(self, folded: str) -> set[str]:
        return self.matcher.terms_outside(folded)


def _counted(sample: DataFrame, make: Callable[[str], set[str]]) -> DataFrame:
    return sample.mapInArrow(_TermCounts(make), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: Column, clean: Column, toxic_docs: int, clean_docs: int) -> Column:
    return F.log((toxic + 0.5) / (toxic_docs + 1.0)) - F.log((clean + 0.5) / (clean_docs + 1.0))


def without_covered(rows: list[tuple[str, float, int, int]], margin: float = 0.5) -> dict[str, float]:
    """Weights of the terms worth keeping, of rows (term, weight, toxic, clean documents).

    Of stems of one word that hit the same documents the longest stays, so a stem is no shorter than what it covers asks
    for; how many clean documents it hits counts in its weight. Then terms go that a shorter stem of about the same
    weight covers.
    """
    longer = {(term[:-1], toxic, clean) for term, _, toxic, clean in rows if not term.endswith(" ")}
    chosen = [r for r in rows if r[0].endswith(" ") or (r[0], *r[2:]) not in longer]
    kept: dict[str, float] = {}
    for term, weight, *_ in sorted(chosen, key=lambda r: (len(r[0]), r[0])):
        covering = (kept.get(term[:n]) for n in range(3, len(term)))
        if not any(w is not None and w >= weight - margin for w in covering):
            kept[term] = weight
    return kept


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Lexicon:
    """Learn terms, exception phrases and the calibration from a bounded sample of labelled documents.

    Terms are words and word beginnings that occur in toxic documents far more often than in others; weights are their
    log odds. A pair of words around a hit that is found in clean documents only becomes an exception phrase. Terms are
    sought with half the odds first and counted again outside the exception phrases, so a word that is common in one
    harmless phrase is no less a term elsewhere. A small logistic regression over the squashed sums gives the
    probability.
    """
    spark = docs.sparkSession
    rows = labelled_sample(docs, labels, label, learn, key, text, TRAIN_ROWS, TRAIN_BYTES)
    toxic_docs, clean_docs = rows.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    if not toxic_docs or not clean_docs:
        share = (toxic_docs + 1) / (toxic_docs + clean_docs + 2)
        return Lexicon(calibration=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    sample = rows.select("text", (F.col("label") > 0).alias("toxic"))
    odds = log_odds(F.col("toxic"), F.col("clean"), toxic_docs, clean_docs)
    often = F.col("toxic") >= LEAST_DOCS
    loose = _counted(sample, candidate_terms).where(often & (odds >= LEAST_ODDS / 2)).withColumn("odds", odds).collect()  # of the bounded sample
    lexicon = Lexicon({r.term: r.odds for r in loose})
    pairs = _counted(sample, _Phrases(lexicon)).where((F.col("toxic") == 0) & (F.col("clean") >= 2))
    lexicon.phrases = frozenset(r.term for r in pairs.select("term").collect())
    terms = _counted(sample, _Outside(lexicon)).where(often & (odds >= LEAST_ODDS)).withColumn("odds", odds).collect()
    final = Lexicon(without_covered([(r.term, r.odds, r.toxic, r.clean) for r in terms]))
    matcher = Matcher(final)
    lexicon = Lexicon(final.terms, frozenset(p for p in lexicon.phrases if matcher.hits(p)))
    shared = spark.sparkContext.broadcast(lexicon.parts())
    measure = text_function(_features(shared), {"d": pa.float64(), "t": pa.float64(), "m": pa.float64()}, "d double, t double, m double")
    found = sample.select(measure(F.col("text")).alias("f"), "toxic").select("f.*", "toxic").toArrow()
    x = np.stack([np.log1p(found.column("d").to_numpy()), np.log1p(found.column("t").to_numpy()), found.column("m").to_numpy()], axis=1)
    lexicon.calibration = calibrate(x, found.column("toxic").to_numpy().astype(float))
    return lexicon


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(full.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (y - p) - ridge * beta * [0, *[1] * x.shape[1]]
        hessian = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def _features(shared) -> Callable[[], Callable[[str], tuple]]:
    def make():
        matcher = Matcher(Lexicon(*shared.value))
        return lambda text: matcher.features(text)[:3]

    return make


def _score(shared) -> Callable[[], Callable[[str], tuple]]:
    def make():
        return Matcher(Lexicon(*shared.value)).score

    return make


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score, predicted (1 if score >= threshold), weight and matches to every row; no shuffle.

    A null text counts as empty and gets the score of a text without a match. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.parts())
    rows = without(docs, *OUTPUT)
    kept = rows.columns
    found = text_function(_score(shared), {"score": pa.float64(), "weight": pa.float64(), "matches": pa.int64()}, "score double, weight double, matches long")
    scored = rows.withColumn("_hv_toxicity", found(named(text)))
    s = F.col("_hv_toxicity.score")
    return scored.select(*[named(c) for c in kept], s.alias("score"), (s >= threshold).cast(T.IntegerType()).alias("predicted"), "_hv_toxicity.weight", "_hv_toxicity.matches")
