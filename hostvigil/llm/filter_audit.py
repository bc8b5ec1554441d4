"""Filter interaction audit: what each filter of a chain removes, for every order of the filters, by decision diagrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import SPACED_WORD, named
from hostvigil.session import materialize

Counts = tuple[int, int, int]  # documents, those of good quality, toxic ones
Check = Callable[[Column, Column], Column]
MOST_FILTERS = 8
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in NUMBERS)

# Failure conditions by name, over the text and its words between white space.
CHECKS: dict[str, Check] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: F.rlike(text, F.lit(r"[#$%&*|]")),
}
REPEAT = "E"  # fails if a smaller key has the same text


class Diagram:
    """A decision diagram over failure bits, whose leaves hold counts.

    Every path passes every level, equal sub-diagrams of a level are one node, and a node carries the sum of the counts
    below it. Two neighbouring levels change places without touching the nodes above: a node of the upper level keeps
    its function and gets two new children, which test the other variable.
    """

    def __init__(self, variables: int, counts: dict[int, Counts]):
        self.order = list(range(variables))
        self.children: list[tuple[int, int] | None] = []
        self.total: list[Counts] = []
        self.levels: list[dict] = [{} for _ in range(variables + 1)]
        self.root = self._build(0, counts)

    def _add(self, level: int, key: object, children: tuple[int, int] | None, total: Counts) -> int:
        known = self.levels[level]
        if key not in known:
            known[key] = len(self.children)
            self.children.append(children)
            self.total.append(total)
        return known[key]

    def _node(self, level: int, low: int, high: int) -> int:
        total = tuple(a + b for a, b in zip(self.total[low], self.total[high]))
        return self._add(level, (low, high), (low, high), total)

    def _build(self, level: int, counts: dict[int, Counts]) -> int:
        if level == len(self.order):
            total = counts.get(0, (0, 0, 0))
            return self._add(level, total, None, total)
        halves: tuple[dict, dict] = ({}, {})
        for mask, n in counts.items():
            halves[mask & 1][mask >> 1] = n
        return self._node(level, self._build(level + 1, halves[0]), self._build(level + 1, halves[1]))

    def swap(self, level: int) -> None:
        """Let the variables of ``level`` and the next one change places."""
        upper, lower = self.levels[level], self.levels[level + 1]
        nodes = list(upper.values())
        upper.clear()
        lower.clear()
        for node in nodes:
            (low_low, low_high), (high_low, high_high) = (self.children[c] for c in self.children[node])
            new = self._node(level + 1, low_low, high_low), self._node(level + 1, low_high, high_high)
            self.children[node] = new
            upper[new] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """(variable, kept, removed) along the path on which every filter is passed."""
        out, node = [], self.root
        for variable in self.order:
            low, high = self.children[node]
            out.append((variable, self.total[low], self.total[high]))
            node = low
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Positions of the n! - 1 swaps of neighbours that lead through all orders of n things.

    The last thing walks from one end to the other between two swaps of the others.
    """
    if n < 2:
        return
    inner, leftward = neighbour_swaps(n - 1), True
    for turn in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if leftward else range(n - 1)
        if turn + 1 < factorial(n - 1):
            yield next(inner) + leftward  # the others stand one place further right when the last is in front
        leftward = not leftward


def all_orders(names: str, counts: dict[int, Counts]) -> list[tuple]:
    """Rows (filter_order, step, and NUMBERS) of every order, from counts by failure mask (bit i: names[i])."""
    n = len(names)
    diagram = Diagram(n, counts)
    paths = {tuple(diagram.order): diagram.steps()}
    for level in neighbour_swaps(n):
        diagram.swap(level)
        paths[tuple(diagram.order)] = diagram.steps()
    failing, alone, shapley = [0] * n, [0] * n, [0] * n
    for path in paths.values():
        failing[path[0][0]] = path[0][2][0]  # nothing stands before the first step
        alone[path[-1][0]] = path[-1][2][0]  # all others are passed before the last
        for variable, _, removed in path:
            shapley[variable] += removed[0]
    rows = []
    for order, path in paths.items():
        written = "".join(names[v] for v in order)
        for step, (v, kept, removed) in enumerate(path, 1):
            rows.append((written, step, kept[0], removed[0], failing[v] - removed[0], alone[v], removed[1], removed[2], shapley[v]))
    return rows


class _Orders:
    """Rows of SCHEMA from rows (part, counts); the counts of a part are one for each mask at most."""

    def __init__(self, names: str):
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(NUMBERS)]
        fields = ["part", "filter_order", "step", *NUMBERS]
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = all_orders(self.names, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts})
                columns = [[part] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)


def failure_masks(docs: DataFrame, checks: dict[str, Check] = CHECKS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, key, digest, mask) of every row, stored; bit i of the mask is set where the i-th check fails."""
    full = F.coalesce(named(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), named(key).alias("key"), full.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)))
    bits = [F.when(check(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, check in enumerate(checks.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    return materialize(rows.select("part", "key", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask")), "filter-masks")


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """Set ``bit`` in the mask of rows whose digest also comes with a smaller key.

    The least key of each digest is found after partial minima and joined on (digest, key), so the rows of a text with
    very many copies spread over all tasks.
    """
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "key"], "left")
    repeats = F.col("first").isNull() & F.col("key").isNotNull()
    return marked.select("part", "key", (F.col("mask") + F.when(repeats, 1 << bit).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, checks: dict[str, Check] = CHECKS, repeat: str | None = REPEAT, key: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: what the filter of that step keeps, removes and loses.

    ``checks`` are failure conditions by one-letter names; ``repeat`` names the filter that fails a row whose text comes
    with a smaller key anywhere in the table (None: no such filter). Columns are those of SCHEMA: kept after the step,
    removed by it, redundant (failing the filter, removed earlier), unique_fails (failing no other filter), good_lost and
    toxic_lost (removed, label 1), and shapley (removed by the filter, summed over all orders).

    A null text counts as empty, a null part as the empty string. A row without a key has no label and never counts as a
    repeat nor makes one; rows that share their key and text are no repeats of each other. A key that is labelled twice
    has its greater labels. An empty table has no parts and gives no rows. Other columns are not read.

    Documents shrink to 40 bytes or so before the first shuffle and to one row per part and mask before the diagrams, so
    a task that holds a diagram holds 2^filters counts, whatever the part's size.
    """
    names = "".join(checks) + (repeat or "")
    if len(set(names)) != len(checks) + bool(repeat) or not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter, all different, not {names!r}")
    rows = failure_masks(docs, checks, key, text, part)
    masks = with_repeats(rows, len(checks)) if repeat else rows
    marks = labels.select(named(key).cast(docs.schema[key].dataType).alias("key"), *[(named(c).cast("int") == 1).alias(a) for c, a in ((good, "good"), (toxic, "toxic"))])
    marks = marks.where("key is not null").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = masks.join(marks, "key", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 2^filters at most
    return parts.mapInArrow(_Orders(names), SCHEMA)
