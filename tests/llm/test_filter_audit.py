import random
import re
from itertools import permutations

import pytest

from hostvigil.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", *audit.NUMBERS]


def fails(rows):
    """The failed filters of each row, by the plain rules."""
    least = {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    out = []
    for key, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        out.append({f for f, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and key > least[t],
        }.items() if bad})
    return out


def plain(rows, labels):
    good, toxic = {}, {}
    for key, q, t in labels:
        if key is not None:
            good[key], toxic[key] = good.get(key) or q == 1, toxic.get(key) or t == 1
    marked = [(r[3] or "", r[0], f) for r, f in zip(rows, fails(rows))]
    out = []
    for part in {m[0] for m in marked}:
        own = [(k, f) for p, k, f in marked if p == part]
        lines, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                failing = sum(name in f for _, f in own)
                lines.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {name} for _, f in own), sum(bool(good.get(k)) for k, _ in gone), sum(bool(toxic.get(k)) for k, _ in gone)])
                shapley[name] += len(gone)
        out += [(*line, shapley[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def cases(seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["a", "bb", "C", "dé", "x#", f"w{rng.randrange(400)}"]) if rng.random() < 0.5 else f"v{j}" for j in range(rng.choice([0, 5, 199, 200, 260]))]
        rows.append((i, rng.choice([" ", "\n"]).join(words), None, rng.choice(["hot"] * 5 + ["b", "", None, "é"])))
    rows += [(rng.randrange(2 * n), rng.choice(rows)[1], None, rng.choice(["hot", "b"])) for _ in range(n)]
    return rows + [(None, rows[0][1], None, "b"), (7, None, None, "hot"), (7, None, None, "hot"), (5, rows[5][1], None, "b"), (None, None, None, None)]


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in range(0, 500, 2)] + [(None, 1, 1), (8, 1, 0), (8, 0, 1)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id LONG, quality INT, toxic INT, part STRING, mask STRING")


def test_equals_plain_loops(make_docs, labels):
    found = audit.audit(make_docs(cases()), labels[1])
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == plain(cases(), labels[0])


def test_orders_reached_by_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in audit.neighbour_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_diagram_keeps_its_function_and_shares_nodes():
    counts = {mask: (1, 0, 0) for mask in range(16)}
    diagram = audit.Diagram(4, counts)
    assert [len(level) for level in diagram.levels] == [1] * 5  # equal counts everywhere
    rng = random.Random(2)
    counts = {mask: (rng.randrange(3), rng.randrange(2), 0) for mask in range(32)}
    diagram = audit.Diagram(5, counts)
    for _ in range(60):
        diagram.swap(rng.randrange(4))
        for mask in range(32):
            node = diagram.root
            for variable in diagram.order:
                node = diagram.children[node][mask >> variable & 1]
            assert diagram.total[node] == counts[mask]
    assert max(len(level) for level in diagram.levels) <= 16


def test_other_filters_and_bad_names(make_docs, labels):
    docs = make_docs([(1, "a b", None, "s"), (2, "a b", None, "s")])
    one = audit.audit(docs, labels[1], {"X": lambda text, words: text == "a b"}, repeat=None).collect()
    assert [tuple(r) for r in one] == [("s", "X", 1, 0, 2, 0, 2, 0, one[0].toxic_lost, 2)]
    only = audit.audit(docs, labels[1], {}, repeat="R").collect()
    assert [(r.filter_order, r.kept, r.removed) for r in only] == [("R", 1, 1)]
    for checks, repeat in (({}, None), ({"AB": audit.CHECKS["A"]}, None), ({"E": audit.CHECKS["A"]}, "E")):
        with pytest.raises(ValueError):
            audit.audit(docs, labels[1], checks, repeat)


def test_odd_rows(spark, odd_docs, no_docs, labels):
    found = audit.audit(odd_docs, labels[1]).collect()
    assert len(found) == 600 * odd_docs.select("source").na.fill("").distinct().count()
    assert audit.audit(no_docs, labels[1]).count() == 0
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert all(r.good_lost == r.toxic_lost == 0 for r in audit.audit(odd_docs, none).collect())
