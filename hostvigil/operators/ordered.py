"""Order-dependent operators that stay parallel when one key holds most of the rows.

A key's time line is cut into chunks. Rows look only inside their chunk; a table with one row per (key, chunk) carries
values across chunk borders. Chunk tables are small, as their size follows the time span, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

CHUNK_SECONDS = 3_600
RANK_BUCKETS = 4096


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def chunk_of(us: Column, seconds: float) -> Column:
    return F.floor(us / F.lit(int(seconds * 1_000_000))).cast("long")


def evaluate_once(frame: DataFrame, *names: str) -> DataFrame:
    """The same frame, with costly columns behind a generator.

    A later filter on such a column would otherwise be pushed below it together with a copy of its whole expression.
    """
    return frame.select(*[c for c in frame.columns if c not in names], F.inline(F.array(F.struct(*names)))).select(*frame.columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys where NULL equals NULL, so that no row with a missing key is lost."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(other[f"_r_{key}"])
    return left.join(other, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_previous(
    frame: DataFrame, keys: Sequence[str], value: str, out: str, default, seconds: float = CHUNK_SECONDS, ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Value of the row before, in (ts, seq) order within keys; ``default`` on the first row."""
    chunked = frame.withColumn("_chunk", chunk_of(micros(ts), seconds))
    last = chunked.groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(ts, seq)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, seq)
    joined = null_safe_join(chunked.withColumn("_inside", F.lag(value).over(inside)), before, [*keys, "_chunk"], "left")
    return joined.select(*frame.columns, F.coalesce("_inside", "_before", F.lit(default)).alias(out))


def with_next(
    frame: DataFrame, keys: Sequence[str], value: str, out: str, seconds: float = CHUNK_SECONDS, ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """First non-null value on a later row, in (ts, seq) order within keys; NULL if there is none."""
    chunked = frame.withColumn("_chunk", chunk_of(micros(ts), seconds))
    first = chunked.where(F.col(value).isNotNull()).groupBy(*keys, "_chunk").agg(F.min(F.struct(ts, seq, value)).getField(value).alias("_first"))
    chunks = chunked.select(*keys, "_chunk").distinct()
    first = null_safe_join(chunks, first, [*keys, "_chunk"], "left")
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    after = first.withColumn("_after", F.first("_first", ignorenulls=True).over(later)).drop("_first")
    # Descending order turns "next" into a running frame, which needs no buffer of the whole chunk.
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(ts), F.desc(seq)).rowsBetween(Window.unboundedPreceding, -1)
    inner = chunked.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return null_safe_join(inner, after, [*keys, "_chunk"], "left").select(*frame.columns, F.coalesce("_inside", "_after").alias(out))


def with_rank(frame: DataFrame, keys: Sequence[str], order: str, bucket: Column, out: str) -> DataFrame:
    """1-based position within keys by ``order``, and the size of the key as ``<out>_of``.

    ``bucket`` must rise with ``order``: ranks are local to a bucket and shifted by the sizes of the buckets before it.
    """
    cut = frame.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys,
        "_bucket",
        (F.sum("_n").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(by_key).alias(f"{out}_of"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    ranked = null_safe_join(cut.withColumn("_row", F.row_number().over(inside)), offsets, [*keys, "_bucket"], "left")
    return ranked.select(*frame.columns, (F.col("_row") + F.col("_offset")).alias(out), f"{out}_of")


def ordered_scan(frame: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable, schema: T.StructType) -> DataFrame:
    """Stream rows, sorted by keys and order, through a Python scan over Arrow batches.

    A key stays in one task and arrives as a sequence of batches, so the scan keeps only its own state in memory.
    """
    return frame.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def cooldown(frame: DataFrame, keys: Sequence[str], seconds: float, ts: str = "ts", seq: str = "seq", spans: int = 8) -> DataFrame:
    """Keep a row if no kept row of its key lies less than ``seconds`` before it. Suppressed rows extend nothing.

    Which rows are kept is a chain from the first row on. Time is cut into chunks of ``spans`` cooldowns, and each chunk
    is followed on its own from every instant at which the chain may enter it, all in its first cooldown: such chains
    soon meet, so a chunk is a short list of entries with the instant at which the next row is due after it. Walking those
    lists along a key gives each chunk its entry, and the chunks then mark their rows, again on their own. So a key with
    very many rows is spread over as many tasks as it has chunks. A row without a time cannot be placed and is left out.
    """
    span = int(seconds * 1_000_000)
    if span <= 0:
        return frame
    chunk = [*keys, "_chunk"]
    timed = frame.withColumn("_us", micros(ts)).where("_us IS NOT NULL").withColumn("_chunk", F.floor(F.col("_us") / F.lit(span * spans)).cast("long"))
    types = [timed.schema[k] for k in chunk]
    longs = T.ArrayType(T.LongType())
    instants = timed.select(*chunk, "_us").distinct()
    entries = ordered_scan(instants, chunk, ["_us"], _EntryScan(chunk, span, spans), T.StructType([*types, T.StructField("starts", longs), T.StructField("exits", longs)]))
    due = ordered_scan(entries, keys, ["_chunk"], _DueScan(list(keys), chunk), T.StructType([*types, T.StructField("_due", T.LongType())]))
    joined = null_safe_join(timed, due, chunk, "inner")
    kept = ordered_scan(joined, chunk, ["_us", seq], _CooldownScan(chunk, span), joined.schema)
    return kept.drop("_us", "_chunk", "_due")


def _segments(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of equal keys in a sorted batch, as (key, start, end)."""
    if not batch.num_rows:
        return
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(c[int(start)].as_py() for c in columns), int(start), int(end)


def _rows(keys: list[tuple], fields: dict[str, list], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array([k[i] for k in keys], schema.field(n).type) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.array(v, pa.list_(pa.int64()) if n != "_due" else pa.int64()) for n, v in fields.items()]], names=[*names, *fields])


class _EntryScan:
    """For each chunk: instants at which a chain may enter it, and when the next row is due after the chunk."""

    def __init__(self, chunk: list[str], span: int, spans: int):
        self.chunk, self.span, self.length = chunk, span, span * spans

    def grow(self, state: tuple, key: tuple, us: np.ndarray) -> tuple:
        """Let the chains see more instants of their chunk, and start new ones at those that can be first."""
        starts, due = state
        limit = key[-1] * self.length + self.span  # no chain is due later when it enters
        if not starts.size or starts[-1] < limit:
            new = us[: int(us.searchsorted(limit)) + 1]
            starts, due = np.concatenate([starts, new]), np.concatenate([due, new + self.span])
        while True:
            at = us.searchsorted(due)
            hit = at < len(us)
            if not hit.any():
                break
            due = np.where(hit, us[np.minimum(at, len(us) - 1)] + self.span, due)
        last = np.append(due[1:] != due[:-1], True)  # of chains that have met, the latest start stands for all
        return starts[last], due[last]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        current, state, done, schema = None, (none, none), [], None
        for batch in batches:
            schema = batch.schema
            us = batch.column(schema.get_field_index("_us")).to_numpy()
            for key, start, end in _segments(batch, self.chunk):
                if key != current:
                    if current is not None:
                        done.append((current, state))
                    current, state = key, (none, none)
                state = self.grow(state, key, us[start:end])
            if len(done) > 1000:
                yield self.made(done, schema)
                done = []
        if current is not None:
            yield self.made([*done, (current, state)], schema)

    def made(self, done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return _rows([k for k, _ in done], {"starts": [s for _, (s, _) in done], "exits": [d for _, (_, d) in done]}, schema, self.chunk)


class _DueScan:
    """Along the chunks of a key: when the next row is due as each chunk begins."""

    def __init__(self, keys: list[str], chunk: list[str]):
        self.keys, self.chunk = keys, chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.iinfo(np.int64).min
        current, due = object(), first
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in self.chunk]
            starts, exits = (batch.column(batch.schema.get_field_index(n)) for n in ("starts", "exits"))
            rows, out = list(zip(*columns)), []
            for i, row in enumerate(rows):
                if row[:-1] != current:
                    current, due = row[:-1], first
                out.append(due)
                entry = starts[i].values.to_numpy()
                at = int(entry.searchsorted(due))
                if at < len(entry):
                    due = exits[i].values[at].as_py()
            if rows:
                yield _rows(rows, {"_due": out}, batch.schema, self.chunk)


class _CooldownScan:
    """The rows of a chunk that the chain meets, jumping from each to the first one at least ``span`` later."""

    def __init__(self, chunk: list[str], span: int):
        self.chunk, self.span = chunk, span

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, due = object(), 0
        for batch in batches:
            us, entry = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("_us", "_due"))
            hits = []
            for key, start, end in _segments(batch, self.chunk):
                if key != current:
                    current, due = key, int(entry[start])
                at = start + int(np.searchsorted(us[start:end], due))
                while at < end:
                    hits.append(at)
                    due = int(us[at]) + self.span
                    at += int(np.searchsorted(us[at:end], due))
            if hits:
                yield batch.take(pa.array(hits))
