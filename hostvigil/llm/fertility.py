"""Quality rules from tokeniser fertility, after simple counts of words, symbols and repeats."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, once_a_worker, text_function, without

CACHE_WORDS = 300_000
SYMBOLS = "#*$%&|<>"
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "chars_per_token", "byte_share", "token_entropy", "kept")


@dataclass(frozen=True)
class Band:
    """What a text may have: characters per token, share of byte-fallback tokens, bits of entropy per token."""

    chars_low: float
    chars_high: float
    byte_share: float
    entropy_low: float
    entropy_high: float


# Bands by script for a vocabulary of Latin-heavy text; a script that is not listed takes OTHER.
BANDS = {
    "latin": Band(1.5, 8.0, 0.10, 5.0, 14.0),
    "cyrillic": Band(1.0, 6.0, 0.30, 4.5, 14.0),
    "greek": Band(0.7, 5.0, 0.60, 4.0, 14.0),
    "arabic": Band(0.7, 5.0, 0.60, 4.0, 14.0),
    "han": Band(0.3, 3.0, 0.90, 4.0, 14.0),
    "other": Band(0.3, 8.0, 0.95, 3.5, 14.0),
}
_RANGES = {
    "latin": "A-Za-zªµºÀ-ÖØ-öø-ɏ",
    "greek": "Ͱ-Ͽ",
    "cyrillic": "Ѐ-ԯ",
    "arabic": "؀-ۿ",
    "han": "぀-ヿ㐀-䶿一-鿿가-힯",
}
_SCRIPTS = {name: re.compile(f"[{chars}]") for name, chars in _RANGES.items()}
_NOT_LATIN = re.compile(f"[^\x00-ɏ]")


def script_of(text: str) -> str:
    """The script with most letters, of the listed ones; ``other`` if there is none."""
    if not _NOT_LATIN.search(text):
        return "latin"
    counts = {name: len(found.findall(text)) for name, found in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines equal to an earlier one, and words in repeated three-word windows.

    ``data`` is the text in UTF-8 and ``words`` its split at ASCII white space.
    """
    chars = len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    symbols = sum(map(text.count, SYMBOLS))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counted, upto = Counter(windows), 0
        for i, window in enumerate(windows):
            if counted[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [line for line in data.split(b"\n") if line.strip()] if b"\n" in data else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


class Fertility(dict):
    """Pieces of words under a SentencePiece vocabulary; as a dictionary, the pieces of words met so far.

    Pieces do not cross white space, so a text is measured word by word. A word is encoded whole, however long: the
    library takes about half a second for a million characters without a space.
    """

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = frozenset(i for i in range(self.model.get_piece_size()) if self.model.is_byte(i))

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        pieces = tuple(self.model.encode(word.decode()))
        if len(word) <= 40:
            self[word] = pieces
        return pieces

    def measure(self, words: list[bytes], chars: int) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share and bits of entropy per token; zeros without words."""
        if len(self) > CACHE_WORDS:
            self.clear()
        counted = Counter(chain.from_iterable(map(self.__getitem__, words)))
        total = sum(counted.values())
        if not total:
            return 0.0, 0.0, 0.0
        fallback = sum(counted[p] for p in self.bytes.intersection(counted))
        log = math.log2
        entropy = log(total) - sum(n * log(n) for n in counted.values()) / total
        return chars / total, fallback / total, max(0.0, entropy)


def _judge(path: str, bands: dict[str, Band], least_words: int, repeat_percent: int) -> Callable[[], Callable[[str], tuple]]:
    def make():
        measure = once_a_worker(("fertility", path), lambda: Fertility(path)).measure

        def judge(text: str) -> tuple:
            data = text.encode()
            words = data.split()
            base = base_counts(text, data, words)
            failed = base[0] < least_words or 100 * base[4] > repeat_percent * base[0]
            chars, share, entropy = measure(words, base[1])
            script = script_of(text)
            band = bands.get(script, bands["other"])
            good = band.chars_low <= chars <= band.chars_high and share <= band.byte_share and band.entropy_low <= entropy <= band.entropy_high
            return (*base, failed, script, chars, share, entropy, not failed and good)

        return judge

    return make


def apply_rules(docs: DataFrame, vocabulary: str, text: str = "text", bands: dict[str, Band] = BANDS, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add the base counts, base_failed, script, the three measures and kept to every row; no shuffle.

    A null text has no words, fails the base rules and is not kept. A text is kept if it passes the base rules and its
    measures lie in the band of its script, borders included. Columns of these names are replaced, rows stay one for one.
    ``vocabulary`` is the path of a SentencePiece file that every executor can open.
    """
    long, double = pa.int64(), pa.float64()
    arrow = dict(zip(OUTPUT, [long] * 5 + [pa.bool_(), pa.string(), double, double, double, pa.bool_()]))
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, chars_per_token double, byte_share double, token_entropy double, kept boolean"
    judged = text_function(_judge(vocabulary, bands, least_words, repeat_percent), arrow, ddl)
    rows = without(docs, *OUTPUT)
    kept = rows.columns
    return rows.withColumn("_hv_rules", judged(named(text))).select(*[named(c) for c in kept], "_hv_rules.*")
