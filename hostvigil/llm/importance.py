"""Importance resampling towards a target: hashed n-gram counts from prefix CRCs, Gumbel scores, the highest drawn."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hostvigil.llm.common import named
from hostvigil.llm.decontaminate import words
from hostvigil.session import materialize

POLYNOMIAL = 0xEDB88320  # of crc32, bits reversed
BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS, PERCENT = 20, 25
SEED = "7"
SLICE_WORDS = 100_000  # words hashed at a time, whole documents at least
OUTPUT = ("n_features", "weight", "score", "rank")
_ONES = np.uint32(0xFFFFFFFF)


# --- checksums of substrings ---
@cache
def byte_table() -> np.ndarray:
    """The checksum step of each byte value."""
    now = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        now = np.where(now & 1, (now >> 1) ^ np.uint32(POLYNOMIAL), now >> 1)
    return now


def apply_map(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits over GF(2), given by its images of the 256 values of each of four bytes."""
    return tables[0][values & 255] ^ tables[1][(values >> 8) & 255] ^ tables[2][(values >> 16) & 255] ^ tables[3][values >> 24]


@cache
def zeros_map(power: int) -> np.ndarray:
    """What 2^power zero bytes behind a text do to its checksum, as tables for apply_map."""
    if power:
        half = zeros_map(power - 1)
        return apply_map(half, half)
    each = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    return (each >> 8) ^ byte_table()[each & 255]


def shifted(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums moved on by as many zero bytes as ``lengths`` says, bit by bit of the lengths."""
    out = sums.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> power) & 1 == 1
        out[on] = apply_map(zeros_map(power), out[on])
    return out


def prefix_sums(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Running checksums of the words joined by one space, at the start and the end of each word."""
    ends = np.fromiter(accumulate(found[1:], lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=zlib.crc32(found[0])), np.uint32, len(found))
    inner = ends[:-1] ^ _ONES
    starts = np.concatenate([np.zeros(1, np.uint32), (inner >> 8) ^ byte_table()[(inner ^ 32) & 255] ^ _ONES])
    return starts, ends


def gram_sums(found: list[bytes], longest: int = LONGEST) -> list[np.ndarray]:
    """For n = 1 to ``longest``, the checksums of all runs of n words, each joined by one space.

    The checksum of a run is that of the text up to its end, less that of the text up to its start moved on by the run's
    length: no run is spelt out.
    """
    starts, ends = prefix_sums(found)
    upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)  # with the space behind
    begin = np.concatenate([np.zeros(1, np.int64), upto[:-1]])
    out = []
    for n in range(1, min(longest, len(found)) + 1):
        lengths = upto[n - 1 :] - 1 - begin[: len(found) - n + 1]
        out.append(ends[n - 1 :] ^ shifted(starts[: len(lengths)], lengths))
    return out


class _Hasher:
    """Buckets of the features of many documents, a slice of documents at a time."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words per document, owner of each feature, bucket of each feature), in the order of the documents."""
        sizes: list[int] = []
        held: list[bytes] = []
        for text in texts:
            found = words(text.as_py() or "")
            sizes.append(len(found))
            held += found
            if len(held) >= SLICE_WORDS:
                yield self.features(sizes, held)
                sizes, held = [], []
        if sizes:
            yield self.features(sizes, held)

    def features(self, sizes: list[int], held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array(sizes, np.int64)
        if not held:
            return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        owners, buckets = [], []
        for n, sums in enumerate(gram_sums(held, self.longest), 1):
            inside = owner[: len(sums)] == owner[n - 1 :]  # runs over the border of two documents are none
            owners.append(owner[: len(sums)][inside])
            buckets.append((sums[inside] % np.uint32(self.buckets)).astype(np.int64))
        return counts, np.concatenate(owners), np.concatenate(buckets)


class _Counts(_Hasher):
    """Rows (bucket, n): the features of one task by bucket."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(self.buckets, np.int64)
        for batch in batches:
            for _, _, buckets in self.slices(batch.column(0)):
                total += np.bincount(buckets, minlength=self.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most ``buckets`` numbers reach the driver."""
    counted = texts.select(named(text).cast("string").alias("text")).mapInArrow(_Counts(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, target over corpus, by bucket."""
    n = float(len(corpus))
    ratio = (target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


class _Weights(_Hasher):
    """(words, features, floored mean gain) of each text."""

    def __init__(self, buckets: int, longest: int, shared):
        super().__init__(buckets, longest)
        self.shared = shared

    def __call__(self, parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = self.shared.value
        for part in parts:
            columns: list[list[np.ndarray]] = [[], [], []]
            for counts, owner, buckets in self.slices(part):
                features = np.bincount(owner, minlength=len(counts))
                ends = np.cumsum(np.bincount(owner, weights=gain[buckets].astype(np.float64), minlength=len(counts)).astype(np.int64))  # whole numbers below 2^53
                sums = np.diff(ends, prepend=0)
                for column, values in zip(columns, (counts, features, sums // np.maximum(features, 1))):
                    column.append(values)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], names=["n_words", "n_features", "weight"])


def measured(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST) -> Column:
    """A struct of n_words, n_features and weight for each text of ``docs``."""
    run = _Weights(len(gain), longest, docs.sparkSession.sparkContext.broadcast(gain))

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(parts)

    return weigh(named(text).cast("string"))


def gumbel(key: Column, seed: str = SEED) -> Column:
    """Floored thousandths of a Gumbel number of the key, the same in every run; a missing key counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Add rank to rows (key, score, row, ...): 1, 2, 3 ... by falling score, then key, then row; null beyond ``percent``.

    Rows are dealt by ranges of that order and sorted in each range. The position within a range and the sizes of the
    ranges before give the rank, so no task holds more than its range; ``row`` differs for all rows, so no range is hot.
    """
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)  # the two halves of that id
    placed = materialize(placed.select(*rows.columns, part.alias("part"), (inside + 1).alias("inside")), "score-ranges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    sizes = materialize(sizes.select("part", "n", ahead.alias("ahead")), "score-range-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = F.col("ahead") + F.col("inside")
    joined = placed.join(F.broadcast(sizes.drop("n")), "part")
    return joined.select(*rows.columns, F.when(rank <= percent * total // 100, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", columns: tuple[str, ...] | None = None,
             buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Draw documents that look like the target: add n_features, weight, score and rank to every row.

    Features are runs of 1 to ``longest`` words, counted in ``buckets`` by their crc32. A bucket's gain compares its share
    in the target with that in all documents; weight is the floored mean gain of a document, 0 without features. score
    adds a Gumbel number of the key, so the highest scores are a draw without replacement by weight. Of the documents
    with ``least_words`` words or more, ``percent`` in a hundred are drawn and ranked from 1; equal scores go by key, null
    keys last.

    Null texts have no words. Repeated rows are drawn as rows and share their score. An empty target or table is no
    error. ``columns`` names the columns to keep (default: the key); columns of the four names are replaced.

    Texts are read twice, for the counts and for the weights, and never shuffled; what is sorted is the kept columns.
    """
    kept = [c for c in (columns if columns is not None else (key,)) if c not in OUTPUT]
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    rows = docs.select(F.struct(*[named(c) for c in kept]).alias("doc"), named(key).alias("key"), measured(docs, gain, text, longest).alias("m"))
    score = F.col("m.weight") + gumbel(F.col("key"), seed)
    rows = rows.select("doc", "key", "m.n_words", "m.n_features", "m.weight", score.alias("score"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "importance-weights")
    able = ranked(rows.where(F.col("n_words") >= least_words), percent)
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return able.unionByName(short).select("doc.*", *OUTPUT)
