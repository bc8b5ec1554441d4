"""Shared pieces: text functions, column handling, hash folds."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper and lower case of the ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words between ASCII white space; bytes.split() cuts at exactly these bytes.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def without(frame: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add; they may be there as extra columns."""
    return frame.drop(*names)


def text_function(make: Callable[[], Callable[[str], tuple]], arrow: dict[str, pa.DataType], ddl: str) -> Callable[[Column], Column]:
    """A column function from text to a struct. ``make`` runs once a task; a null text counts as empty.

    Rows travel in Arrow batches, so a task holds one batch of texts at a time.
    """
    names, types = list(arrow), list(arrow.values())

    @F.arrow_udf(ddl)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for part in parts:
            rows = [one(value.as_py() or "") for value in part]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return lambda text: run(text.cast("string"))


def fold_of(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a missing key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def share_broadcast(frame: DataFrame, max_rows: int) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``max_rows`` rows; otherwise leave the join to Spark."""
    return F.broadcast(frame) if frame.limit(max_rows + 1).count() <= max_rows else frame


def once_a_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by a worker process from task to task; the latest few keys only.

    Functions travel to workers by value, with module variables of their own, so it is kept in a module of its own.
    """
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("values", {})
    if key not in kept:
        while len(kept) >= 4:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


LETTER = re.compile(r"[^\W\d_]")
