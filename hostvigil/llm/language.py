"""Language identification as a mixture of languages, estimated per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import LETTER, named, text_function, without

BUCKETS = 1 << 16
MODEL_VALUES = 1 << 24
SMOOTHING = 0.5
STEPS = 30
PENALTY = 6.0
UNKNOWN = "und"
OUTPUT = ("lang_pred", "score", "languages", "proportions")

# Bytes of ASCII characters other than letters become spaces.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the byte trigrams of a text: lower case, letters only, single spaces."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if codes.size < 3:
        return np.empty(0, dtype=np.int64)
    codes = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % buckets


class _Counts:
    """Gram counts per language of one task, as rows (lang, bucket, n)."""

    def __init__(self, buckets: int, held: int = 32):
        self.buckets, self.held = buckets, held

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in counts:
                    if len(counts) >= self.held:
                        yield from self.rows(counts)
                        counts = {}
                    counts[lang] = np.zeros(self.buckets, dtype=np.int64)
                counts[lang] += np.bincount(grams(text.as_py(), self.buckets), minlength=self.buckets)
        yield from self.rows(counts)

    @staticmethod
    def rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, values in counts.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(values[at], pa.int64())], names=["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    names: list[str]
    logp: np.ndarray  # one row per bucket, one column per language


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Smoothed gram likelihoods per language, counted over all rows that have a text and a language.

    Counts are summed per task before the shuffle. The model has at most MODEL_VALUES numbers: the buckets shrink if
    there are more than 256 languages.
    """
    known = rows.where(named(text).isNotNull() & named(lang).isNotNull()).select(named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text"))
    languages = known.select("lang").distinct().count()
    buckets = BUCKETS
    while buckets > 256 and buckets * languages > MODEL_VALUES:
        buckets //= 2
    counted = known.mapInArrow(_Counts(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    values = np.full((buckets, len(names)), SMOOTHING)
    columns = np.array([place[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    values[counted.column("bucket").to_numpy(), columns] += counted.column("n").to_numpy()
    return LanguageModel(names, np.log(values / values.sum(axis=0)).astype(np.float32) if names else values)


def proportions(likelihood: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Maximum-likelihood mixture proportions by expectation-maximisation, and their log likelihood."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = weight.sum()
    for _ in range(steps):
        mixed = likelihood @ share
        following = share * ((weight / mixed) @ likelihood) / total
        done = np.abs(following - share).max() < 1e-3
        share = following
        if done:
            break
    return share, float(weight @ np.log(likelihood @ share))


def infer(text: str, model: LanguageModel, penalty: float = PENALTY) -> tuple[str, float, list[str], list[float]]:
    """Predicted language, its proportion in the mixture of all languages, and the selected set with proportions.

    The set grows along the order of proportions while the log likelihood gains more than ``penalty`` * log(grams) for
    each language added.
    """
    if not model.names or not LETTER.search(text):
        return UNKNOWN, 0.0, [], []
    found, weight = np.unique(grams(text, model.logp.shape[0]), return_counts=True)
    logp = model.logp[found].astype(np.float64)
    likelihood = np.exp(logp - logp.max(axis=1, keepdims=True))
    share, _ = proportions(likelihood, weight)
    order = np.lexsort((np.arange(share.size), -share))
    best, chosen, chosen_share = -np.inf, order[:1], np.ones(1)
    cost = penalty * np.log(max(2, weight.sum()))
    for size in range(1, order.size + 1):
        part = order[:size]
        part_share, fit = proportions(likelihood[:, part], weight) if size > 1 else (np.ones(1), float(weight @ np.log(np.maximum(likelihood[:, part[0]], 1e-300))))
        if fit - cost * size <= best:
            break
        best, chosen, chosen_share = fit - cost * size, part, part_share
    first = chosen[int(np.argmax(chosen_share))]
    return model.names[first], float(min(1.0, max(0.0, share[first]))), [model.names[i] for i in chosen], [float(x) for x in chosen_share]


def _infer(shared, penalty: float) -> Callable[[], Callable[[str], tuple]]:
    def make():
        model = LanguageModel(*shared.value)
        return lambda text: infer(text, model, penalty)

    return make


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add lang_pred, score, languages and proportions to every row; no shuffle.

    Null texts and texts without a letter get ``und`` and 0; so does every text if nothing was learned. Columns of these
    names are replaced, rows stay one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.logp))
    arrow = {"lang_pred": pa.string(), "score": pa.float64(), "languages": pa.list_(pa.string()), "proportions": pa.list_(pa.float64())}
    rows = without(docs, *OUTPUT)
    found = text_function(_infer(shared, penalty), arrow, "lang_pred string, score double, languages array<string>, proportions array<double>")
    kept = rows.columns
    return rows.withColumn("_hv_language", found(named(text))).select(*[named(c) for c in kept], "_hv_language.*")
