"""Token counts of byte-pair encoding, without making the tokens."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, once_a_worker, text_function, without

# Pre-tokenisation of byte-level BPE, published with the vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same cut for texts below U+0250, where letters, numbers and white space are few enough to name.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
NEAR_PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
CACHE_WORDS = 600_000
OUTPUT = ("n_bytes", "n_tokens", "over_limit")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class BytePairCounter(dict):
    """Counts tokens of a text under a byte-level merge table; as a dictionary, the counts of pre-tokens met so far.

    A pre-token starts as one symbol a byte. Adjacent pairs wait in a heap by (rank, position); the lowest is merged
    into its left symbol, which is linked to the symbol after the pair, and the two pairs that this makes join the heap.
    Each merge takes one symbol away, so the count is the symbols at the start minus the merges; no identifiers are made.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab = model["vocab"]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[left], vocab[right]), rank)
            self.made.append(vocab[left + right])
        self.first = [vocab[s] for s in byte_symbols()]
        self.words, self.near_words, self.far = regex.compile(PRE_TOKEN), re.compile(NEAR_PRE_TOKEN), re.compile("[^\x00-\u024f]")
        special = sorted((t["content"] for t in data.get("added_tokens", []) if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def merges(self, data: bytes) -> int:
        first, ranks, made = self.first, self.ranks, self.made
        symbols = [first[b] for b in data]
        n = len(symbols)
        heap = [rank * n + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one side has been merged since
            symbols[i], symbols[j] = made[rank], -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, found * n + i)
            h = before[i]
            if h >= 0 and (found := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, found * n + h)
        return done

    def __missing__(self, word: str) -> int:
        data = word.encode()
        count = len(data) - self.merges(data)
        if len(data) < 64:
            self[word] = count
        return count

    def plain(self, text: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self.words.findall(text) if self.far.search(text) else self.near_words.findall(text)
        return sum(map(self.__getitem__, found))

    def count(self, text: str) -> int:
        """Special strings in a text are one token each, as the library's default has it."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def _counter(path: str) -> Callable[[], Callable[[str], tuple]]:
    def make():
        counter = once_a_worker(("tokens", path), lambda: BytePairCounter(path))
        return lambda text: (counter.count(text),)

    return make


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row; no shuffle.

    A null or empty text has 0 bytes and 0 tokens. Rows stay one for one, repeated ones too; columns of these three names
    are replaced, all others are kept. ``vocabulary`` is the path of a byte-level BPE file that every executor can open,
    as it comes with an installed package. A pre-token of any length takes n log n steps.
    """
    counted = text_function(_counter(vocabulary), {"n": pa.int64()}, "n long")
    rows = without(docs, *OUTPUT)
    n = counted(named(text))
    return rows.withColumn("_hv_tokens", n["n"]).select(
        *[named(c) for c in rows.columns],
        F.coalesce(F.octet_length(named(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.col("_hv_tokens").alias("n_tokens"),
        (F.col("_hv_tokens") > limit).alias("over_limit"),
    )
