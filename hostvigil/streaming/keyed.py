"""State per key in event-time order: a key's rows of one trigger, however many, pass a scan sorted by time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD_ROWS = 500_000
INPUT = ("row_us", "row_seq", "row_code")  # Spark renames columns that begin with an underscore on the way to Python


class Chain:
    """A cooldown: kept is a row at least ``span`` after the last kept one. The state is that row's time."""

    state, out = "last long", []

    def __init__(self, span: int):
        self.span = span

    def begin(self, value: tuple | None) -> None:
        self.last = None if value is None else value[0]

    def useful(self, block: np.ndarray) -> np.ndarray:
        """Without the rows that the state suppresses whatever else comes."""
        return block if self.last is None else block[:, block[0] >= self.last + self.span]

    def pick(self, block: np.ndarray) -> tuple[np.ndarray, dict]:
        us, kept = block[0], []
        at = 0 if self.last is None else int(us.searchsorted(self.last + self.span))
        while at < len(us):  # from kept row to kept row
            kept.append(at)
            self.last = int(us[at])
            at += int(us[at:].searchsorted(self.last + self.span))
        return np.array(kept, dtype=np.int64), {}

    def end(self) -> tuple | None:
        return None if self.last is None else (self.last,)

    def useless_after(self) -> int:
        return self.last + self.span


class Changes:
    """Rows whose code differs from the one before, ``names[0]`` before the first. The state is the last code."""

    state, out = "last long", ["old_state", "new_state"]

    def __init__(self, names: list[str]):
        self.names = np.array(names, dtype=object)

    def begin(self, value: tuple | None) -> None:
        self.last = 0 if value is None else value[0]

    def useful(self, block: np.ndarray) -> np.ndarray:
        return block

    def pick(self, block: np.ndarray) -> tuple[np.ndarray, dict]:
        now = block[2]
        before = np.concatenate([[self.last], now[:-1]])
        self.last = int(now[-1])
        at = np.flatnonzero(now != before)
        return at, {"old_state": self.names[before[at]], "new_state": self.names[now[at]]}

    def end(self) -> tuple | None:
        return (self.last,)


class InTimeOrder(StatefulProcessor):
    """Feeds a key's rows (time, sequence, code) to a scan in order of time and sequence, and keeps the scan's state.

    Up to ``held`` rows of a key are sorted in memory. Beyond that they go into the state store, cut by time into slices;
    one slice after the other is then sorted and scanned. So memory holds ``held`` rows or one slice of one key, and
    what stays in the state between triggers is one value.
    """

    def __init__(self, scan, keys: list[str], slice_us: int, held: int = HELD_ROWS, expires: bool = False):
        self.scan, self.keys, self.slice_us, self.held, self.expires = scan, keys, max(1, slice_us), held, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.scan.state)
        self.slices = handle.getMapState("slices", "slice long, part long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.scan.begin(self.last.get() if self.last.exists() else None)
        held, size, parts = [], 0, {}
        for batch in rows:
            block = self.scan.useful(np.stack([batch[c].to_numpy(np.int64) for c in INPUT]))
            held.append(block)
            size += block.shape[1]
            if size > self.held:
                self.put(held, parts)
                held, size = [], 0
        if parts:
            self.put(held, parts)
            held = []
            for number in sorted(parts):
                yield from self.picked(key, self.take(number, parts[number]))
        elif size:
            yield from self.picked(key, np.concatenate(held, axis=1))
        self.keep()

    def put(self, held: list[np.ndarray], parts: dict[int, int]) -> None:
        """Store rows by slice, in parts that are numbered within their slice."""
        if not held:
            return
        block = np.concatenate(held, axis=1)
        numbers = block[0] // self.slice_us
        order = np.argsort(numbers, kind="stable")
        block, numbers = block[:, order], numbers[order]
        borders = np.flatnonzero(np.diff(numbers)) + 1
        for number, part in zip(numbers[np.concatenate([[0], borders])] if numbers.size else [], np.split(block, borders, axis=1)):
            n = parts.get(int(number), 0)
            self.slices.updateValue((int(number), n), (np.ascontiguousarray(part).tobytes(),))
            parts[int(number)] = n + 1

    def take(self, number: int, parts: int) -> np.ndarray:
        out = []
        for n in range(parts):
            out.append(np.frombuffer(self.slices.getValue((number, n))[0], dtype=np.int64).reshape(3, -1))
            self.slices.removeKey((number, n))
        return np.concatenate(out, axis=1)

    def picked(self, key, block: np.ndarray) -> Iterator[pd.DataFrame]:
        block = block[:, np.lexsort((block[1], block[0]))]
        at, more = self.scan.pick(block)
        if at.size:
            same = {k: pd.Series([v] * at.size, dtype=object) for k, v in zip(self.keys, key)}
            yield pd.DataFrame({**same, "seq": block[1][at], "_us": block[0][at], **more})

    def keep(self) -> None:
        value = self.scan.end()
        if value is None:
            return
        self.last.update(value)
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.scan.useless_after() // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def scan_by_key(rows: DataFrame, keys: list[str], scan, out: str, slice_us: int, held: int = HELD_ROWS, delay: str | None = None) -> DataFrame:
    """Rows (keys, seq, _us, ...) that the scan picks from a stream of (keys, seq, ts, _code); one value of state per key.

    With ``delay`` the stream has a watermark, and an event-time timer clears the state of a key that cannot matter any
    more. The stream's session needs the RocksDB state store, see durable.stream_session.
    """
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay else timed
    timed = timed.select(*keys, F.unix_micros("ts").alias(INPUT[0]), F.col("seq").cast("long").alias(INPUT[1]), F.col("_code").alias(INPUT[2]), *["ts"] * bool(delay))
    schema = ", ".join([*(f"`{k}` {timed.schema[k].dataType.simpleString()}" for k in keys), "seq LONG", "_us LONG", *([out] if out else [])])
    processor = InTimeOrder(scan, keys, slice_us, held, bool(delay))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime" if delay else "None")


