"""SimHash fingerprints, links within a Hamming radius by covering masks, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, text_function, without
from hostvigil.session import materialize

BITS = 64
SEED = 42
RADIUS = 3
SHINGLE = 3
BLOCK = 256


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*[words[i:] for i in range(width)])]
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 16_384):  # long texts in slices
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + 16_384]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _fingerprints(width: int):
    return lambda: lambda text: (signed(fingerprint(text, width)),)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = SHINGLE, out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long. A null text has no words and gets 0."""
    rows = without(docs, out)
    hashed = text_function(_fingerprints(width), {"fp": pa.int64()}, "fp long")
    return rows.withColumn(out, hashed(named(text))["fp"])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that two values within the radius agree under at least one.

    Bit i carries a non-zero vector of radius+1 bits; the mask of v holds the bits whose vector has an odd product with
    v. The at most ``radius`` differing bits give that many equations, so some v != 0 solves them all: its mask holds
    none of those bits. Each mask holds about half of the bits.
    """
    vectors = (1 << (radius + 1)) - 1
    carried = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (carried[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


class _BlockLinks:
    """Links inside one block of a bucket, as a spanning forest, from rows sorted by block.

    Breadth-first search takes what it reaches out of the rest, so a block of close fingerprints needs about one
    comparison a member, and at most one link a member leaves the block however many pairs are close.
    """

    def __init__(self, radius: int, keys: list[str]):
        self.radius, self.keys = radius, keys

    def forest(self, values: np.ndarray) -> list[tuple[int, int]]:
        rest, links = np.unique(values).view(np.uint64), []  # of signed values bitwise_count takes the absolute value
        while rest.size:
            todo, rest = [rest[0]], rest[1:]
            while todo and rest.size:
                node = todo.pop()
                close = np.bitwise_count(rest ^ node) <= self.radius
                if close.any():
                    found = rest[close]
                    links += [(signed(int(node)), signed(x)) for x in found.tolist()]
                    todo += list(found)
                    rest = rest[~close]
        return links

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush(out: list) -> None:
            if held:
                out += self.forest(np.concatenate(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in self.keys]
            values = batch.column(batch.schema.get_field_index("fp")).to_numpy(zero_copy_only=False)
            change = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            starts = [0, *np.flatnonzero(change), batch.num_rows]
            out: list = []
            for a, b in zip(starts, starts[1:]):
                key = tuple(k[a] for k in keys)
                if key != current:
                    flush(out)
                    current, held = key, []
                held.append(values[a:b])
            if out:
                yield self.edges(out)
        out = []
        flush(out)
        if out:
            yield self.edges(out)

    @staticmethod
    def edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``fps`` holds distinct values in ``fp``.

    The result is no list of all close pairs but enough of them: what is connected by close pairs is connected here.
    Each mask gives one table; only buckets with two or more members go on. A bucket of more than ``block`` members is
    cut into chunks, and each pair of chunks is one block of its own, so no task holds a large bucket.
    """
    spark = fps.sparkSession
    masks = F.array(*[F.lit(signed(m)) for m in covering_masks(radius)])
    tables = F.posexplode(masks).alias("t", "mask")
    keyed = fps.select("fp", tables).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    sizes = materialize(keyed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    members = keyed.join(sizes, ["t", "bucket"])
    chunks = F.ceil(F.col("n") / block).cast("int")
    cut = members.withColumn("g", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    paired = cut.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = paired.select("t", "bucket", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "fp")
    keys = ["t", "bucket", "lo", "hi"]
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys)
    found = ordered.mapInArrow(_BlockLinks(radius, keys), "a long, b long")
    return materialize(found.distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node that can be reached.

    Alternating large-star and small-star steps until the links no longer change, each written to the shared folder.
    Minima are merged before the shuffle; a node with very many links meets its minimum in a join that Spark can split.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = materialize(edges.where("a <> b").select(*pair).distinct(), "stars")
    mark = _signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-stars")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        before, mark = mark, _signature(now)
        if mark == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(frame: DataFrame) -> tuple[int, int]:
    row = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (hex), component_id.

    component_id is the smallest key of all rows reached over links; null keys come last, so it is null only where no
    row of the component has a key. Rows without words have fingerprint 0 and link like any other. Repeated rows stay.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = materialize(with_fingerprint(docs.select(named(key).alias("key"), named(text).alias("text")), width=width).select("key", "fp"), "fingerprints")
    joined = rows.join(labels(rows, radius), "fp")
    return joined.select(F.col("key").alias(key), hex16(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def labels(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, least): the smallest key of each fingerprint's component, from stored rows (key, fp).

    Copies meet before anything else: one row per distinct fingerprint goes into the search.
    """
    fps = materialize(rows.groupBy("fp").agg(F.min("key").alias("key")), "distinct-fingerprints")
    roots = materialize(components(links(fps, radius)), "components")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "key", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("key").alias("least")), "component-ids")
    return materialize(rooted.join(least, "root").select("fp", "least"), "labels")


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest key, of equal keys one. Columns stay as they are.

    Null keys come last, rows without words have fingerprint 0 and are one component, and an empty table stays empty. Rows
    are stored once with a number and their fingerprint. The numbers of the rows to keep meet them in a sort-merge join
    at every size, so what is shuffled is in proportion to the input.
    """
    whole = F.struct(*[named(c) for c in docs.columns]).alias("doc")
    hashed = text_function(_fingerprints(width), {"fp": pa.int64()}, "fp long")
    stored = docs.select(whole, F.monotonically_increasing_id().alias("row"), hashed(named(text)).alias("h"))
    stored = materialize(stored.select("doc", "row", F.col("h.fp").alias("fp")), "near-duplicate-rows")
    rows = stored.select(F.col("doc")[key].alias("key"), "fp", "row")
    fps = rows.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"))
    fps = materialize(fps.select("fp", F.col("first.row").alias("row"), F.struct("first.none", "first.key", "first.row").alias("key")), "distinct-fingerprints")
    roots = materialize(components(links(fps.select("fp"), radius)), "components")
    kept = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("key").alias("first"))
    kept = materialize(kept.select(F.col("first.row").alias("row")), "kept-rows")
    return stored.join(kept.hint("merge"), "row", "left_semi").select("doc.*")
