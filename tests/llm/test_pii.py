import hashlib
import random
import re

import pytest

from hostvigil.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in value if c.isdigit()])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind, value):
    n = sum(c in "0123456789" for c in value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= n <= 19 and luhn(value)
    return kind == "email" or 10 <= n <= 15


def plain(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def card(rng, n):
    body = [rng.randrange(10) for _ in range(n - 1)]
    return next(s for c in range(10) if luhn(s := "".join(map(str, body + [c]))))


def texts(seed=4):
    rng = random.Random(seed)
    parts = [
        "a@b.co", "x.y%z@mail-1.example.com", "_q@r.st.", "a@b@c.de", "a@b", "@", "p@q.r_s@t.uv", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "1.2.3", "9.9.9.99999999999",
        "+1 (974) 555-3436", "+123456789", "+1234567890123456", "+1+22 333 444 5555", "12", "5--6", "é", "漢", "𝔘", " ", "-", ".", "\n", "x",
    ]
    out = []
    for i in range(400):
        row = [rng.choice(parts) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            row.insert(rng.randint(0, len(row)), card(rng, rng.randint(13, 20)))
        if i % 5 == 0:
            row.insert(rng.randint(0, len(row)), re.sub(r"(\d{4})(?=\d)", r"\1" + rng.choice(" -"), card(rng, 16)))
        out.append((i, rng.choice(["", " "]).join(row)))
    out += [(1000, None), (1001, ""), (1002, "1" * 2000), (1005, "a@b" + ".c" * 2000), (1006, "+1" + " 1" * 2000), (1007, "1 " * 2000)]
    return out


def test_very_long_texts(make_docs):
    """Runs for which a plain search takes quadratic time or deep recursion."""
    rows = [(1, "1" * 60_000), (2, "a" * 100_000), (3, "a.b" * 20_000 + "@"), (4, "a@b" + ".c" * 30_000), (5, "+1" + " 1" * 40_000), (6, "1 " * 30_000), (7, "z@y.x " * 5000)]
    found = {r.doc_id: r for r in pii.detect(make_docs(rows), columns=("doc_id",)).collect()}
    assert {k: r.spans for k, r in found.items() if k < 7} == {1: "", 2: "", 3: "", 4: "email:0:60003", 5: "", 6: ""}
    assert found[7].n_email == 5000 and found[7].spans.endswith("email:29994:29999")


def test_base_spans_equal_the_plain_patterns(make_docs):
    rows = texts()
    found = {r.doc_id: r for r in pii.detect(make_docs(rows), columns=("doc_id",)).collect()}
    for key, text in rows:
        want = plain(text)
        row = found[key]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[3] == k for s in want) for k in BASE), (key, text[:80])
        assert row.base_sha256 == digest(want), (key, text[:80], row.spans[:200], want[:9])
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(row.spans.split(",")) | {""}


def test_contexts_of_known_values_find_unseen_ones(make_docs):
    rng = random.Random(1)
    rows = [(i, f"some words here. phone number: +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} and more") for i in range(30)]
    rows += [(100 + i, f"other words. Phone  number: {rng.randint(2000000, 9999999)}. the end") for i in range(5)]
    rows += [(200 + i, f"build of version {rng.randint(100000, 999999)} of the tool, phone calls too") for i in range(20)]
    found = {r.doc_id: r for r in pii.detect(make_docs(rows), columns=("doc_id", "text")).collect()}
    for i in range(5):
        row = found[100 + i]
        start = re.search(r"\d{7}", row.text).start()
        assert row.spans == f"phone:{start}:{start + 7}" and row.n_phone == 0 and row.base_sha256 == digest([])
    assert all(found[200 + i].spans == "" for i in range(20))
    assert all(found[i].spans.count("phone") == 1 for i in range(30))


def test_glued_and_long_identifiers_are_learned(make_docs):
    long = "k" * 60 + "123456789"
    rows = [(i, f"is the owner [a{i}@c.de] here") for i in range(30)] + [(100, "is the owner [kk1234567] here"), (101, f"is the owner [{long}] here")]
    rows += [(200 + i, f"please use my own Email:x{i}@y.org today") for i in range(30)] + [(300, "please use my own Email:kk1234567 today")]
    rows += [(400 + i, f"codes sent to {10**9 + i} {20**7 + i} a{i}@q.org now") for i in range(30)] + [(500, "codes sent to 1234567890 2345678901 zz98765 now")]
    found = {r.doc_id: r for r in pii.detect(make_docs(rows), columns=("doc_id", "text")).collect()}
    for key, value in ((100, "kk1234567"), (101, long), (300, "Email:kk1234567")):
        start = rows[[k for k, _ in rows].index(key)][1].index(value)
        assert found[key].spans == f"email:{start}:{start + len(value)}", found[key]
    redacted = {r.doc_id: r.text for r in pii.redact(make_docs(rows)).collect()}
    assert redacted[101] == "is the owner [<EMAIL>] here" and redacted[3] == "is the owner [<EMAIL>] here"


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    """Each pattern shares values with the next one only."""
    n = 8
    edges = [("p0 x", f"+{i}", 5, "phone") for i in range(4)]
    for k in range(n):
        edges += [(f"p{k} x", f"v{k}-{i}", 5, None) for i in range(4)] + [(f"p{k + 1} x", f"v{k}-{i}", 5, None) for i in range(4)]
    occurs = [(f"p{k} x", 20) for k in range(n + 1)]
    graph = spark.createDataFrame(edges, "pattern STRING, value STRING, n LONG, kind STRING")
    table = spark.createDataFrame(occurs, "pattern STRING, occurs LONG")
    assert {r.pattern for r in pii.score_patterns(graph, table).collect()} == {f"p{k} x" for k in range(n + 1)}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "r", "f", "d", "b")], "doc_id LONG, text STRING, row STRING, full STRING, doc STRING, _hv_text STRING")
    assert tuple(pii.redact(docs).first()) == (1, "<EMAIL>", "r", "f", "d", "b")
    assert tuple(pii.detect(docs).first())[:6] == (1, "a@b.co", "r", "f", "d", "b")


def test_common_words_before_a_value_are_no_pattern(make_docs):
    rng = random.Random(2)
    rows = [(i, f"of the {card(rng, 16)} and so on. the cat of the house. end of the day. one of the few") for i in range(20)]
    rows += [(100, "part of the 98765432 left")]
    found = {r.doc_id: r for r in pii.detect(make_docs(rows), columns=("doc_id",)).collect()}
    assert found[100].spans == "" and found[0].n_card == 1


def test_rounds_reach_patterns_through_learned_values(spark):
    edges = [("a b", f"+{i}", 10, "phone") for i in range(5)] + [("a b", f"n{i}", 2, None) for i in range(4)] + [("c d", f"n{i}", 4, None) for i in range(4)] + [("c d", "m", 4, None)]
    edges += [("e f", f"+{i}", 1, "phone") for i in range(5)]
    graph = spark.createDataFrame(edges, "pattern STRING, value STRING, n LONG, kind STRING")
    occurs = spark.createDataFrame([("a b", 60), ("c d", 17), ("e f", 5000)], "pattern STRING, occurs LONG")
    assert {r.pattern for r in pii.score_patterns(graph, occurs, rounds=1).collect()} == {"a b"}
    assert {(r.pattern, r.kind) for r in pii.score_patterns(graph, occurs).collect()} == {("a b", "phone"), ("c d", "phone")}


def test_redaction(make_docs, odd_docs, no_docs):
    docs = make_docs([(1, "mail é a@b.co or 1.2.3.4, ok"), (2, "+1 (974) 555-3436"), (3, None), (4, "none"), (4, "none")])
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == [(1, "mail é <EMAIL> or <IP>, ok"), (2, "<PHONE>"), (3, ""), (4, "none"), (4, "none")]
    key = lambda r: (r.doc_id or 0, r.text or "")
    assert sorted(map(key, pii.redact(odd_docs).collect())) == sorted(map(key, odd_docs.collect()))
    assert pii.redact(no_docs).count() == 0 and pii.detect(no_docs).count() == 0


@pytest.mark.parametrize("value,good", [("79927398713", True), ("79927398710", False), ("0", True)])
def test_luhn(spark, value, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(value)).alias("x")).first().x == good
