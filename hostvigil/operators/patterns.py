"""Pattern tables of any size: an index of the literals that a regex needs, and a check of the few that a line may match."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.functions.text import fold_case, java_regex

LEAST_LITERAL = 3
PART_PATTERNS = 200_000  # patterns that are shared with the executors at a time
# Letters that a case-insensitive match also equates with others are no part of a literal.
_PLAIN = re.compile(r"[A-Za-z0-9 _/:;,=@<>&%#\"'~`!-]")
_QUANTIFIER = re.compile(r"[*+?]|\{\d*,?\d*\}")


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals one of which is in every text that the pattern matches; None if that cannot be told.

    A top-level alternative counts by its longest run of plain characters. Groups, classes, and characters that may be
    left out end a run; what they hold is not looked at, so the answer may be less than the pattern needs, never more.
    """
    runs: list[list[str]] = [[""]]
    at, depth = 0, 0
    while at < len(pattern):
        ch = pattern[at]
        size, plain = 1, ch if _PLAIN.fullmatch(ch) else None
        if ch == "\\":
            size, escaped = 2, pattern[at + 1 : at + 2]
            if not escaped or escaped.isdigit() or escaped in "QExuNpPcCkg":
                return None  # quoted, coded or referring: not read here
            plain = escaped if not escaped.isalnum() and escaped.isascii() else None
        elif ch == "[":
            end = at + 1 + pattern[at + 1 : at + 2].count("^")
            end += pattern[end : end + 1].count("]")  # a bracket in front is a member
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            size = end + 1 - at
        elif ch == "(":
            if pattern.startswith("(?", at) and not re.match(r"\(\?(:|P?<[A-Za-z]|=|!|<=|<!)", pattern[at:]):
                return None  # flags may change what is plain
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            runs.append([""])
            at += 1
            continue
        at += size
        counted = _QUANTIFIER.match(pattern, at)
        if depth or plain is None or ch == ")":
            if ch not in "^$" and not (ch == "\\" and pattern[at - 1] in "bB"):  # what takes no character ends no run
                runs[-1].append("")
        elif counted is None:
            runs[-1][-1] += plain
        else:
            if counted[0] == "+":
                runs[-1][-1] += plain
            runs[-1].append("")
        if counted:
            at = counted.end()
            at += pattern[at : at + 1] in ("?", "+")  # lazy or possessive
    best = [max(branch, key=len).lower() for branch in runs]
    return best if all(len(b) >= LEAST_LITERAL for b in best) else None


class _Index:
    """Patterns by their literals, in one automaton; patterns without one are candidates of every line."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.spelled = [(number, pattern, java_regex(pattern)) for number, pattern in rows]
        self.always: list[int] = []
        owners: dict[str, list[int]] = {}
        for i, (_, pattern) in enumerate(rows):
            literals = required_literals(pattern)
            if literals is None:
                self.always.append(i)
            for literal in set(literals or ()):
                owners.setdefault(literal, []).append(i)
        self.machine = ahocorasick.Automaton()
        for literal, own in owners.items():
            self.machine.add_word(literal, own)
        self.machine.make_automaton()

    def candidates(self, folded: str | None) -> list[dict] | None:
        if folded is None:
            return None
        found = set(self.always)
        if len(self.machine):
            for _, own in self.machine.iter(folded):
                found.update(own)
        return [dict(zip(("id", "pattern", "java"), self.spelled[i])) for i in sorted(found)]


_CANDIDATES = pa.list_(pa.struct([("id", pa.int64()), ("pattern", pa.string()), ("java", pa.string())]))


def _finder(shared) -> Callable:
    @F.arrow_udf("array<struct<id:long,pattern:string,java:string>>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _Index(shared.value)
        for part in parts:
            yield pa.array([index.candidates(x) for x in part.to_pylist()], _CANDIDATES)

    return find


def first_pattern_match(lines: DataFrame, table: DataFrame, column: str = "raw_line", part: int = PART_PATTERNS) -> DataFrame:
    """Add pattern_id and pattern: the first row, by id, of a (pattern_id, pattern) table whose regex matches the line.

    The patterns of a line come from an index of their literals, and only those are tried, in the order of their ids. So a
    line pays for the patterns that it may match, the plan is the same for any table, and no line is shuffled. The table is
    a dimension that users write; it is shared in parts of ``part`` patterns, and a line that has met its first match
    passes by the later parts. Patterns that are null never match, nor do null lines.
    """
    spark = lines.sparkSession
    rows = table.where("pattern_id IS NOT NULL AND pattern IS NOT NULL").select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern")
    kind = table.schema["pattern_id"].dataType
    found = lines.withColumns({"_folded": fold_case(F.col(column)), "_first": F.lit(None).cast("struct<id:long,pattern:string,java:string>")})
    iterator, held, started = rows.orderBy("pattern_id").toLocalIterator(), [], False
    while True:
        row = next(iterator, None)
        if row is not None:
            held.append((row.pattern_id, row.pattern))
        if len(held) >= part or row is None and (held or not started):
            shared, started = spark.sparkContext.broadcast(held), True
            open_line = F.when(F.col("_first").isNull(), F.col("_folded"))
            found = found.withColumn("_maybe", _finder(shared)(open_line))
            hit = F.filter("_maybe", lambda p: F.rlike(F.col(column), p["java"]))
            found = found.withColumn("_first", F.coalesce("_first", F.get(hit, F.lit(0)))).drop("_maybe")
            held = []
        if row is None:
            break
    return found.select(*lines.columns, F.col("_first.id").cast(kind).alias("pattern_id"), F.col("_first.pattern").alias("pattern"))
