"""Personal data: fixed patterns, and identifiers found by contexts learned from them; DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, share_broadcast, without
from hostvigil.operators.ordered import evaluate_once
from hostvigil.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds, with guards and possessive quantifiers: each finds what the plain pattern finds from left to
# right, but a failed start is not tried again inside the same run, so long runs take linear time and no recursion.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}  # a text without this character has no match
CANDIDATE = r"(?<!\S)(?=\S*?[0-9@])\S++"
BEFORE = 200  # characters before an identifier in which its two context words stand whole
LEAST_CHARS, LEAST_DIGITS = 5, 4
NODE_CHARS = 64  # longer values are nodes of the graph by their digest
LEAST_SUPPORT, LEAST_PRECISION, ROUNDS = 3.0, 0.6, 50
MAX_SHARED = 200_000
OUTPUT = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans")

BLOCK = 128
_PAIRS = "array<struct<m:string,p:string>>"
_FOUND = "array<struct<start:bigint,end:bigint,value:string,pattern:string>>"
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def pairs(text: Column, matches: Column, pattern: str) -> Column:
    """Each match (m) with the piece of text before it (p)."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    return F.when(F.size(matches) > 0, F.arrays_zip(matches.alias("m"), pieces.alias("p"))).otherwise(F.array().cast(_PAIRS))


def located(zipped: Column) -> Column:
    """Start, end, value and context of each match, in code points, from stored pairs.

    Lengths are added up block by block, and blocks are joined at the end: an array that grows by one element is copied
    each time, which a text of very many matches would feel.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = (start + F.length(x["m"])).cast("bigint")
        before = F.right(F.concat(acc["last"], x["p"]), F.lit(BEFORE))
        found = F.struct(start.cast("bigint").alias("start"), end.alias("end"), x["m"].alias("value"), context(before).alias("pattern"))
        last = F.right(F.concat(acc["last"], x["p"], x["m"]), F.lit(BEFORE))
        return F.struct(end.alias("at"), last.alias("last"), F.concat(acc["out"], F.array(found)).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), acc["last"].alias("last"), F.array().cast(_FOUND).alias("out"))
        inner = F.aggregate(F.slice(zipped, i * BLOCK + 1, F.lit(BLOCK)), begin, step)
        return F.struct(inner["at"].alias("at"), inner["last"].alias("last"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(" ").alias("last"), F.array().cast(f"array<{_FOUND}>").alias("out"))
    return F.when(F.size(zipped) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(_FOUND))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn sum: from the right every second digit is doubled, less 9 if over 9."""
    figures = F.split(F.reverse(digits(value)), "")
    total = F.aggregate(
        figures,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, d: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["sum"] + F.when(acc["i"] % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(F.split(value, r"\."), lambda p: F.right(p, F.lit(9)).cast("long") <= 255)


def _kept(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.filter(found, lambda s: octets(s["value"]))
    if kind == "card":
        return F.filter(found, lambda s: luhn(s["value"]))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(digits(s["value"])).between(10, 15))
    return found


def context(before: Column) -> Column:
    """The two words before the word that ends the text or is about to begin, in lower case; null if there are not two.

    An identifier that is glued to a bracket or a label has the context of the whole word. White space must stand before
    the first context word, so a word that is cut at the front is none.
    """
    words = F.regexp_extract(before, r"(?<=\s)(\S++\s++\S++)\s++\S*+$", 1)
    return F.nullif(F.regexp_replace(F.lower(words), r"\s+", " "), F.lit(""))


def _all_base(kinds: tuple[str, ...] = KINDS) -> Column:
    """The base spans of all kinds as one array in order of start, then kind."""
    def spans(i: int, k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))

    parts = [spans(i, k) for i, k in enumerate(kinds)]
    return F.array_sort(F.concat(*parts).cast(_SPANS))


def base_spans(rows: DataFrame) -> DataFrame:
    """Add an array per kind, found (tokens that may be identifiers) and base to rows (doc, full), full being the text."""
    t, none = F.col("full"), F.array().cast("array<string>")
    every = [*PATTERNS.items(), ("found", CANDIDATE)]
    names = [k for k, _ in every]
    rows = rows.withColumns({f"m_{k}": F.when(F.contains(t, F.lit(HINTS[k])) if k in HINTS else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in every})
    rows = evaluate_once(rows, *[f"m_{k}" for k in names])
    rows = rows.withColumns({f"z_{k}": pairs(t, F.col(f"m_{k}"), p) for k, p in every}).drop(*[f"m_{k}" for k in names])
    rows = evaluate_once(rows, *[f"z_{k}" for k in names])
    rows = rows.withColumns({k: _kept(k, located(F.col(f"z_{k}"))) for k in names})
    rows = evaluate_once(rows.drop(*[f"z_{k}" for k in names]), *names)
    return evaluate_once(rows.withColumn("base", _all_base()), "base")


def trimmed(value: Column) -> tuple[Column, Column]:
    """The value without what is neither letter nor digit at its ends (a leading + stays), and the characters cut in front."""
    ahead = F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}+]*+", 0))
    back = F.length(F.regexp_extract(F.reverse(value), r"^[^\p{L}\p{N}]*+", 0))
    return F.substr(value, ahead + 1, F.greatest(F.length(value) - ahead - back, F.lit(0))), ahead


def candidates() -> Column:
    """Tokens that look like identifiers outside the base spans, trimmed, with the two words before."""

    def cut(s: Column) -> Column:
        value, ahead = trimmed(s["value"])
        return F.struct((s["start"] + ahead).alias("start"), (s["start"] + ahead + F.length(value)).alias("end"), value.alias("value"), s["pattern"].alias("pattern"))

    sized = F.transform(F.filter(F.col("found"), lambda s: s["pattern"].isNotNull()), cut)
    like = F.filter(sized, lambda s: (F.length(s["value"]) >= LEAST_CHARS) & ((F.length(digits(s["value"])) >= LEAST_DIGITS) | F.contains(s["value"], F.lit("@"))))
    return F.filter(like, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def seeds() -> Column:
    """Base values with their kind and the two words before."""

    def of(k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(s["pattern"].alias("pattern"), s["value"].alias("value"), F.lit(k).alias("kind")))

    return F.filter(F.concat(*map(of, KINDS)), lambda s: s["pattern"].isNotNull())


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each of the given two-word patterns occurs in all texts, as (pattern, occurs)."""
    words = texts.select(F.split(F.lower("full"), r"\s+").alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.inline(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))))
    wanted = patterns.select("pattern", F.substring_index("pattern", " ", 1).alias("a"), F.substring_index("pattern", " ", -1).alias("b"))
    return pairs.join(share_broadcast(wanted, MAX_SHARED), ["a", "b"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("occurs"))


def score_patterns(edges: DataFrame, occurs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """High-confidence patterns (pattern, kind, precision) of a pattern-instance graph.

    ``edges`` is (pattern, value, n, kind), kind set for seeds. A pattern's precision is the share of its occurrences
    that are followed by an instance, weighted by the instance's score; its support is the sum of scores of its distinct
    instances. Accepted patterns score their other instances, by noisy or, and those count as evidence in the next round,
    until a round accepts the same patterns as the one before. More than ``rounds`` rounds end with a warning.
    """
    edges = edges.join(occurs, "pattern").withColumn("seed", F.col("kind").isNotNull())
    edges = materialize(edges, "pattern-instances")
    trusted = materialize(edges.where("seed").groupBy("value").agg(F.lit(1.0).alias("trust"), F.min("kind").alias("of")), "trusted")
    before = None
    for _ in range(rounds):
        known = edges.join(trusted, "value")
        mass = [F.sum(F.when(F.col("of") == k, F.col("n") * F.col("trust")).otherwise(0.0)).alias(f"w{i}") for i, k in enumerate(KINDS)]
        best = F.greatest(*[F.struct(F.col(f"w{i}").alias("w"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
        scored = known.groupBy("pattern").agg(*mass, F.sum("trust").alias("support"), F.max("occurs").alias("occurs")).withColumn("best", best)
        scored = scored.withColumn("precision", F.least(F.lit(1.0), F.col("best.w") / F.col("occurs")))
        accepted = materialize(scored.where((F.col("support") >= LEAST_SUPPORT) & (F.col("precision") >= LEAST_PRECISION)).select("pattern", "best.kind", "precision"), "accepted-patterns")
        now = accepted.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "kind").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return accepted
        before = now
        missed = F.sum(F.log1p(-F.least("precision", F.lit(0.999))))
        new = edges.where("not seed").join(accepted.withColumnRenamed("kind", "of"), "pattern").groupBy("value").agg((1 - F.exp(missed)).alias("trust"), F.max_by("of", "precision").alias("of"))
        both = trusted.where("trust = 1").unionByName(new)
        trusted = materialize(both.groupBy("value").agg(F.max("trust").alias("trust"), F.max_by("of", "trust").alias("of")), "trusted")
    if rounds > 1:
        warnings.warn(f"contexts still changed in round {rounds}; the patterns of that round are used", RuntimeWarning, stacklevel=2)
    return accepted


def find_spans(docs: DataFrame, text: str = "text", columns: tuple[str, ...] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc, full, base, spans) for every row: the chosen columns as a struct, the text, and base and all spans, sorted.

    The rows are stored once: with the text among the columns, or apart from them.
    """
    kept = list(columns) if columns is not None else docs.columns
    full = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("full")
    rows = base_spans(docs.select(F.struct(*[named(c) for c in kept]).alias("doc"), full(named(text))))
    rows = rows.select("doc", F.monotonically_increasing_id().alias("row"), *["full"] * (text not in kept), "base", seeds().alias("seeds"), candidates().alias("candidates"))
    stored = materialize(rows, "personal-data")
    if text in kept:
        stored = stored.withColumn("full", full(F.col("doc")[text]))
    seen = stored.select(F.inline("seeds"))
    other = stored.select("row", F.inline("candidates"))
    node = F.when(F.length("value") <= NODE_CHARS, F.col("value")).otherwise(F.sha2("value", 256)).alias("value")
    counted = seen.select("pattern", node, "kind").unionByName(other.select("pattern", node, F.lit(None).cast("string").alias("kind")))
    edges = materialize(counted.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")), "graph")
    sums = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("most"))
    wanted = materialize(sums.where(F.col("values") >= LEAST_SUPPORT).select("pattern", "most"), "patterns")
    # Texts with identifiers alone show most patterns to be too common to reach the precision, whatever their instances.
    some = occurrences(stored.where((F.size("seeds") > 0) | (F.size("candidates") > 0)), wanted)
    able = wanted.join(some, "pattern", "left").where(F.col("most") >= LEAST_PRECISION * F.coalesce("occurs", F.lit(0)))
    able = materialize(able.select("pattern"), "specific-patterns")
    occurs = materialize(occurrences(stored, able), "pattern-occurrences")
    accepted = score_patterns(edges, occurs, rounds)
    found = other.join(share_broadcast(accepted, MAX_SHARED), "pattern")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    spans = F.collect_list(F.struct("start", rank.cast("int").alias("rank"), "end", "kind"))  # of one text
    added = materialize(found.groupBy("row").agg(spans.cast(_SPANS).alias("added")), "learned-spans")
    joined = stored.join(share_broadcast(added, MAX_SHARED), "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return joined.select("doc", "full", "base", every.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, text: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Add n_<kind> and base_sha256 of the base spans, and spans, the text form of all spans, to every row.

    Positions are code points, ends exclusive. A null text counts as empty. Columns of these names are replaced, rows
    stay one for one. Learned spans have the kind that most trusted instances of their context have.
    """
    rows = without(docs, *OUTPUT)
    found = find_spans(rows, text, columns)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc.*", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each span replaced by <KIND>; overlapping spans become one, named after the first. Null texts stay null."""
    found = find_spans(docs, text)
    t = F.col("full")
    swapped = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(t, acc["at"].cast("int") + 1)),
    )
    own = F.col("doc")[text]
    clean = F.when(own.isNull() | (F.size("spans") == 0), own).otherwise(swapped)
    return found.select(*[(clean if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
