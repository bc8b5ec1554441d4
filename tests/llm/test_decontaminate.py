import hashlib
import random
import re

import pytest

from hostvigil.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, items, width=13):
    words, hit, found = plain_words(text), set(), set()
    for key, item in items:
        own = plain_words(item)
        for at in range(max(1, len(own) - width + 1) if own else 0):
            window = own[at : at + width]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    if key is not None:
                        found.add(str(key))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def cases(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "Éa", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 12, 13, 14, 20, 40])))) for i in range(25)]
    items = [(k, t) for k, t in items if len(plain_words(t)) not in (1,)] + [(None, items[5][1]), (90, None), (91, "zz"), items[3], (92, "aa bb cc, dd")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 30, 400])))) for i in range(30)]
    docs += [(100 + i, "q w e " * n + (items[i][1] or "") + " - r t" * n) for i in range(12) for n in (0, 9)]
    docs += [(200, None), (201, "zz"), (202, "Zz,zz"), (203, "aa bb\ncc dd aa bb cc dd"), (204, "a " * 50_000)]
    return docs, items


@pytest.mark.parametrize("max_windows", [100_000, 40])
def test_equals_brute_force(spark, make_docs, max_windows):
    docs, items = cases()
    frame = make_docs(docs + docs[:2])
    table = spark.createDataFrame(items, "item_id INT, text STRING")
    rows = decontaminate.search_benchmark(frame, table, max_windows=max_windows)
    assert rows.columns == [*frame.columns, *decontaminate.OUTPUT]
    found = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows.collect())
    long = {204: None}
    want = sorted((k, *plain(t, items)) for k, t in docs + docs[:2] if k not in long)
    assert [r for r in found if r[0] not in long] == want


def test_repeated_words_far_beyond_a_window(spark, make_docs):
    table = spark.createDataFrame([(1, "a " * 13)], "item_id INT, text STRING")
    row = decontaminate.search_benchmark(make_docs([(1, "a " * 50_000)]), table).first()
    assert (row.n_words, row.n_hit, row.n_items) == (50_000, 50_000, 1)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id INT, text STRING")
    assert {(r.n_hit, r.contaminated) for r in decontaminate.search_benchmark(odd_docs, none).collect()} == {(0, False)}
    one = spark.createDataFrame([(1, "one two")], "item_id INT, text STRING")
    assert decontaminate.search_benchmark(no_docs, one).count() == 0
    assert sum(r.contaminated for r in decontaminate.search_benchmark(odd_docs, one).collect()) == 3


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "one two", "a", "b", "c")], "doc_id LONG, text STRING, _hv_0 STRING, _hv_items STRING, doc STRING")
    items = spark.createDataFrame([(7, "one two")], "item_id LONG, text STRING")
    row = decontaminate.search_benchmark(docs, items).first()
    assert tuple(row)[:5] == (1, "one two", "a", "b", "c") and (row.n_words, row.n_hit, row.contaminated) == (2, 2, True)
