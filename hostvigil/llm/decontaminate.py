"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in every document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, once_a_worker, text_function, without
from hostvigil.session import materialize

WINDOW = 13
SHARE = 20
MAX_WINDOWS = 100_000
OUTPUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")

# ASCII letters are folded, digits, letters and all bytes of other characters make words, everything else parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Multi-pattern search over words. Patterns of one length share a shift table over blocks of words.

    The block that ends a window says how far the window may move on: the least distance from that block to the end of a
    pattern, or the whole window if no pattern holds the block. At distance 0 the bucket of that suffix block, split
    by the pattern's first block, lists the patterns that are compared with the text word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], block: int = 2):
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for pattern in patterns:
            by_length.setdefault(len(pattern), []).append(pattern)
        self.owners = patterns
        self.tables = [self._table(m, group, min(block, m)) for m, group in sorted(by_length.items())]

    @staticmethod
    def _table(m: int, group: list[tuple[bytes, ...]], block: int):
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[bytes, ...]]]] = {}
        for pattern in group:
            for end in range(block, m + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, m), m - end)
            buckets.setdefault(pattern[m - block :], {}).setdefault(pattern[:block], []).append(pattern)
        return m, block, shift, m - block + 1, buckets

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, tuple[bytes, ...]]]:
        """(start, end, pattern) of every occurrence, for each length in order of position."""
        n = len(text)
        for m, block, shift, most, buckets in self.tables:
            end = m
            if block == 2:
                while end <= n:
                    last = (text[end - 2], text[end - 1])
                    step = shift.get(last, most)
                    if step:
                        end += step
                        continue
                    start = end - m
                    for pattern in buckets[last].get((text[start], text[start + 1]), ()):
                        if all(map(bytes.__eq__, pattern, text[start:end])):
                            yield start, end, pattern
                    end += 1
                continue
            while end <= n:
                last = tuple(text[end - block : end])
                step = shift.get(last, most)
                if step:
                    end += step
                    continue
                start = end - m
                for pattern in buckets[last].get(tuple(text[start : start + block]), ()):
                    if all(map(bytes.__eq__, pattern, text[start:end])):
                        yield start, end, pattern
                end += 1

    def hits(self, text: str) -> tuple[int, list[int], list[int], list[str]]:
        """Number of words, starts and ends of the covered stretches, and the items found."""
        found = words(text)
        starts: list[int] = []
        ends: list[int] = []
        items: set[str] = set()
        for start, end, pattern in sorted(self.search(found), key=lambda x: x[0]):
            items.update(self.owners[pattern])
            if ends and start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        return len(found), starts, ends, sorted(items)


class _Windows:
    """Windows of benchmark items, as rows (window, item)."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text or "")
                for at in range(max(1, len(found) - self.width + 1) if found else 0):
                    windows.append(b" ".join(found[at : at + self.width]).decode())
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(items, pa.string())], names=["window", "item"])


def search_tables(rows: list[tuple[str, str | None]]) -> WuManber:
    """The tables for rows (window, item); equal words are held once."""
    patterns: dict[tuple[bytes, ...], list[str]] = {}
    interned: dict[bytes, bytes] = {}
    for window, item in rows:
        owners = patterns.setdefault(tuple(interned.setdefault(w, w) for w in window.encode().split(b" ")), [])
        if item is not None:
            owners.append(item)
    return WuManber(patterns)


def _search(shared, name: str) -> Callable[[], Callable[[str], tuple]]:
    return lambda: once_a_worker(("benchmark", name), lambda: search_tables(shared.value)).hits


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (window, item), stored: 13 consecutive words, or the whole item if it has fewer but some."""
    rows = items.select(named(key).cast("string").alias("item"), named(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_Windows(width), "window string, item string").distinct(), "benchmark-windows")


def search_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text",
                     width: int = WINDOW, share: int = SHARE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to every row of ``docs``.

    n_hit counts words inside occurrences of benchmark windows; contaminated means n_hit > 0 and share * n_hit >= n_words.
    Null or empty texts have no words and are clean; an empty benchmark hits nothing; an item without id hits but is not
    listed; repeated items count once. Rows stay one for one; columns of the five names are replaced.

    The windows are cut into parts of about ``max_windows`` by hash, and each part is shared with all executors on its
    own: documents pass the parts one after another without a shuffle, so no benchmark is too large.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(items, key, item_text, width)
    total = windows.count()
    parts = max(1, -(-total // max_windows))
    rows = without(docs, *OUTPUT)
    # The caller's columns travel in one struct, so no name of theirs can meet one of these.
    out = rows.select(F.struct(*[named(c) for c in rows.columns]).alias("doc"), named(text).cast("string").alias("text"))
    arrow = {"n": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
    ddl = "n long, starts array<int>, ends array<int>, items array<string>"
    for k in range(parts):
        chosen = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in chosen.collect()])
        out = out.withColumn(f"_hv_{k}", text_function(_search(shared, uuid.uuid4().hex), arrow, ddl)(F.col("text")))
    spans = F.concat(*[F.arrays_zip(F.col(f"_hv_{k}.starts").alias("starts"), F.col(f"_hv_{k}.ends").alias("ends")) for k in range(parts)])
    found = F.array_distinct(F.concat(*[F.col(f"_hv_{k}.items") for k in range(parts)]))
    covered = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["ends"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(acc["upto"], s["starts"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    out = out.select("doc", F.col("_hv_0.n").alias("n_words"), covered.alias("n_hit"), F.array_sort(found).alias("_hv_items"))
    return out.select(
        "doc.*",
        "n_words",
        "n_hit",
        F.size("_hv_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hv_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
