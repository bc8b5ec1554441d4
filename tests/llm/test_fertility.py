import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from hostvigil.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def cases():
    rng = random.Random(6)
    out = []
    for i in range(120):
        word = lambda: rng.choice(["a", "b", "é#", "word", "x|y", "漢", "\x85", "z\x1c"])
        out.append((i, "".join(word() + rng.choice([" ", "\n", "\t", "\x0b", "  \n"]) for _ in range(rng.choice([0, 2, 3, 40, 200])))))
    return out + [(900, None), (901, ""), (902, "a b c a b c"), (903, "x" * 200_000), (904, "one\none\n \n \none")]


def test_base_counts_equal_the_plain_form(make_docs):
    rows = fertility.apply_rules(make_docs(cases()), PATH).collect()
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert found == {k: plain(t) for k, t in cases()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_measures_equal_the_library_on_words():
    text = "The quick brown fox, jumps over ünïcode 漢字 words again and again"
    words = text.encode().split()
    ids = Counter(i for w in text.split() for i in MODEL.encode(w))
    total = sum(ids.values())
    chars, share, entropy = fertility.Fertility(PATH).measure(words, sum(len(w) for w in text.split()))
    assert chars == sum(len(w) for w in text.split()) / total
    assert share == sum(n for i, n in ids.items() if MODEL.is_byte(i)) / total and share > 0
    assert abs(entropy + sum(n / total * math.log2(n / total) for n in ids.values())) < 1e-9
    assert total == len(MODEL.encode(text))


def test_long_unspaced_words_are_measured_whole():
    rng = random.Random(9)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1000)), "éß" * 700, "ab" * 3000):
        ids = Counter(MODEL.encode(text))
        chars, share, _ = fertility.Fertility(PATH).measure(text.encode().split(), len(text))
        assert chars == len(text) / sum(ids.values())
        assert share == sum(n for i, n in ids.items() if MODEL.is_byte(i)) / sum(ids.values())


def test_bands_by_script(make_docs):
    rng = random.Random(7)
    common = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()
    good = " ".join(rng.choice(common) for _ in range(300))
    junk = " ".join("".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(4)) for _ in range(300))
    docs = make_docs([(1, good), (2, " ".join(f"w {i % 3}" for i in range(300))), (3, "🜁" * 500), (4, good + " " + "Ж" * 3)])
    found = {r.doc_id: (r.script, r.kept) for r in fertility.apply_rules(docs, PATH).collect()}
    assert found[1] == ("latin", True) and not found[2][1] and not found[3][1] and found[4][0] == "latin"
    assert fertility.script_of("привет мир") == "cyrillic" and fertility.script_of("漢字 abc 漢字漢") == "han" and fertility.script_of("!?…") == "other"
    assert fertility.script_of(junk) == "other"


def test_odd_rows(odd_docs, no_docs):
    rows = fertility.apply_rules(odd_docs, PATH)
    assert rows.columns == [*odd_docs.columns, *fertility.OUTPUT]
    assert rows.count() == odd_docs.count() and fertility.apply_rules(no_docs, PATH).count() == 0
