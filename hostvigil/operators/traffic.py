"""Request windows: sliding totals, top sources, flood patterns and risk per request."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from hostvigil.operators.ordered import _segments, evaluate_once, micros, null_safe_join, ordered_scan, with_next, with_previous
from hostvigil.session import materialize

# Defaults of the detector; the per-minute horizon and the distributed-flood minimum are fixed values.
WINDOW_SECONDS = 10
REQUEST_THRESHOLD = 100
IP_THRESHOLD = 50
ENDPOINT_THRESHOLD = 200
MINUTE_SECONDS = 60
DISTRIBUTED_IPS = 15

GROUP_ROWS = 1_000_000
MAX_CELLS = 64
CELL_WINDOWS = 4  # windows of one cell of a host that is not split
MAX_NAMES = 100_000  # names, or heap entries, a scan may hold beyond those of its window
TRIM_ROWS = 100_000

# Kinds of rows in a cell, in the order of the scan.
_BEFORE, _BY_IP, _BY_ENDPOINT, _OWN = range(4)
_SHIFT = 40
_PLACE = (1 << _SHIFT) - 1


def busy_hosts(requests: DataFrame, seconds: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Hosts with more than ``group_rows`` requests in a window, with _m: into how many cells their windows are cut.

    A power of two that rises with the busiest window. One pass over host and time, counted before the shuffle. Each of
    these hosts stands for that many requests, so the table is small.
    """
    span = int(seconds * 1_000_000)
    busiest = (
        requests.groupBy("hostname", F.floor(micros("ts") / F.lit(span)).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("hostname")
        .agg(F.max("_n").alias("_n"))
    )
    cells = F.least(F.lit(MAX_CELLS), F.pow(F.lit(2), F.ceil(F.log2(F.col("_n") / F.lit(float(group_rows)))))).cast("long")
    return busiest.where(F.col("_n") > group_rows).select("hostname", cells.alias("_m"))


def with_cells(requests: DataFrame, seconds: int, group_rows: int = GROUP_ROWS, busy: DataFrame | None = None) -> DataFrame:
    """Add _m, the cells of a window: those of ``busy_hosts``, and one for every other host."""
    busy = busy_hosts(requests, seconds, group_rows) if busy is None else busy
    joined = null_safe_join(requests, F.broadcast(busy), ["hostname"], "left")
    return joined.withColumn("_m", F.coalesce("_m", F.lit(1).cast("long")))


def sliding_window(
    requests: DataFrame, seconds: int, total: str = "total_requests", source: DataFrame | None = None, minute: int | None = None
) -> DataFrame:
    """Aggregates over the requests of the same host in [t - seconds, t], one row per request.

    Requests at the same instant count only if they arrived earlier. Adds the total, distinct IPs, the most frequent IP
    and endpoint with their counts (first seen wins a tie), and error responses.

    No pairs are formed. A host's time line is cut into cells, and each cell is one ordered scan over its own requests
    and over those before it that are still in a window. A cell spans several windows, so few requests are in two of
    them; ``minute`` then adds requests_per_minute, the requests in [t - minute, t], in the same scan. Where
    ``with_cells`` gave hosts several cells per window, the cells in the middle of the window enter as counts by IP and
    by endpoint. ``source`` holds the same requests in a form that is cheaper to read for these counts.
    """
    span = int(seconds * 1_000_000)
    row = F.struct(*[F.col(c) for c in requests.columns])
    error = F.coalesce((F.col("status") >= 400).cast("long"), F.lit(0).cast("long"))
    shared = [F.col("hostname"), F.col("_us"), F.col("seq"), F.lit(1).cast("long").alias("_n"), F.col("ip").alias("_ip"), F.col("endpoint").alias("_endpoint"), error.alias("_error")]
    if "_m" in requests.columns:
        timed = _with_cell(requests, span)
        places = F.array(_place(F.col("_cell"), _OWN), _place(F.col("_cell") + F.col("_m"), _BEFORE))
    else:
        reach = max(span, int((minute or 0) * 1_000_000))
        length = reach * CELL_WINDOWS
        timed = requests.withColumn("_us", micros("ts")).withColumn("_cell", F.expr(f"(_us - pmod(_us, {length}L)) div {length}L"))
        own, later = _place(F.col("_cell"), _OWN), _place(F.col("_cell") + 1, _BEFORE)
        places = F.when(F.pmod("_us", F.lit(length)) < length - reach, F.array(own)).otherwise(F.array(own, later))
    own = timed.select(*shared, row.alias("_row"), F.explode(places).alias("_p"))
    laid = own.select(
        "hostname", "_p.cell", "_p.role", "_us", "seq", "_n", "_ip", "_endpoint", "_error", F.when(F.col("_p.role") == _OWN, F.col("_row")).alias("_row")
    )
    # Without a column of cells no host is split, and there is no middle.
    if "_m" in requests.columns:
        middle = _with_cell(requests if source is None else source, span).where(F.col("_m") > 1)
        for name, role in (("_ip", _BY_IP), ("_endpoint", _BY_ENDPOINT)):
            group = middle.select(*shared, "_cell", "_m").groupBy("hostname", "_cell", "_m", name)
            counted = group.agg(
                F.count(F.lit(1)).alias("_n"), F.min(F.struct("_us", "seq")).alias("_f"), F.sum("_error").alias("_error")
            ).withColumn("cell", F.explode(F.sequence(F.col("_cell") + 1, F.col("_cell") + F.col("_m") - 1)))
            laid = laid.unionByName(
                counted.select(
                    "hostname", "cell", F.lit(role).alias("role"), F.col("_f._us").alias("_us"), F.col("_f.seq").alias("seq"), "_n",
                    *[F.col(c) if c == name else F.lit(None).cast("string").alias(c) for c in ("_ip", "_endpoint")],
                    "_error", F.lit(None).cast(laid.schema["_row"].dataType).alias("_row"),
                )
            )
    counts = [*(["requests_per_minute"] if minute else []), total, "unique_ips", "top_ip", "top_ip_requests", "top_endpoint", "top_endpoint_requests", "error_requests"]
    kinds = {"top_ip": T.StringType(), "top_endpoint": T.StringType()}
    fields = [T.StructField("_row", laid.schema["_row"].dataType), *[T.StructField(c, kinds.get(c, T.LongType())) for c in counts]]
    scan = _WindowScan(span, int(minute * 1_000_000) if minute else None)
    scanned = ordered_scan(laid, ["hostname", "cell"], ["role", "_us", "seq"], scan, T.StructType(fields))
    return scanned.select("_row.*", *counts)


def sliding_count(requests: DataFrame, seconds: int, total: str, source: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """Number of requests of the same host in [t - seconds, t], one row per request, in window functions alone.

    ``only`` is a condition on the requests that count; every request gets its row all the same.

    The cells are those of ``sliding_window``: a cell holds its own requests and those of the cell a window before. A
    request counts what stands before it in its cell, plus the older cell without what has left the window, plus the
    cells in between, which enter as counts.
    """
    span = int(seconds * 1_000_000)
    counts = F.lit(1) if only is None else F.coalesce(only, F.lit(False)).cast("int")
    timed = _with_cell(requests, span).withColumn("_n", counts.cast("long"))
    own = F.lit(1).cast("long")
    laid = timed.withColumn("_p", F.explode(F.array(F.struct(F.col("_cell").alias("cell"), own.alias("own")), F.struct((F.col("_cell") + F.col("_m")).alias("cell"), (own - 1).alias("own")))))
    laid = laid.withColumns({"_at": F.col("_p.cell"), "_own": F.col("_p.own")}).drop("_p")
    cell = Window.partitionBy("hostname", "_at")
    seen = F.sum(F.col("_own") * F.col("_n")).over(cell.orderBy("_us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    old = (1 - F.col("_own")) * F.col("_n")
    left = F.sum(old).over(cell.orderBy("_us").rangeBetween(Window.unboundedPreceding, -(span + 1)))
    older = F.sum(old).over(cell)
    counted = laid.withColumn("_total", seen + older - F.coalesce(left, F.lit(0))).where("_own = 1")
    if "_m" in requests.columns:
        middle = _with_cell(requests if source is None else source, span).where(F.col("_m") > 1)
        sums = middle.groupBy("hostname", "_cell", "_m").agg(F.sum(counts.cast("long")).alias("_n"))
        sums = sums.select("hostname", F.explode(F.sequence(F.col("_cell") + 1, F.col("_cell") + F.col("_m") - 1)).alias("_at"), "_n")
        counted = null_safe_join(counted, sums.groupBy("hostname", "_at").agg(F.sum("_n").alias("_middle")), ["hostname", "_at"], "left")
        counted = counted.withColumn("_total", F.col("_total") + F.coalesce("_middle", F.lit(0)))
    return counted.select(*requests.columns, F.col("_total").alias(total))


def sliding_distinct(requests: DataFrame, seconds: int, name: str, out: str) -> DataFrame:
    """Number of different values of ``name`` among the host's requests in [t - seconds, t], in window functions alone.

    A value is alive from a request until ``seconds`` after it, longer if it comes again by then. Stretches of being
    alive begin and end at known instants, so the number alive is what has begun less what has ended: a running sum, taken
    inside cells of time, and over the cells of a host. Steps that read their input more than once read it stored.
    """
    span = int(seconds * 1_000_000)
    timed = materialize(requests.withColumn("_us", micros("ts")), "timed-requests")
    before = materialize(with_previous(timed, ["hostname", name], "_us", "_before", None), "requests-before")
    around = materialize(with_next(before, ["hostname", name], "_us", "_after"), "requests-around")
    begins = F.col("_before").isNull() | (F.col("_before") < F.col("_us") - span)
    ends = F.col("_after").isNull() | (F.col("_after") > F.col("_us") + span)
    row = F.struct(*[F.col(c) for c in requests.columns])
    arrive = around.select("hostname", "_us", F.lit(1).alias("_order"), "seq", begins.cast("long").alias("_d"), row.alias("_row"))
    leave = around.where(ends).select("hostname", (F.col("_us") + span + 1).alias("_us"), F.lit(0).alias("_order"), "seq", F.lit(-1).cast("long").alias("_d"), F.lit(None).cast(arrive.schema["_row"].dataType).alias("_row"))
    moves = arrive.unionByName(leave).withColumn("_cell", F.floor(F.col("_us") / F.lit(span)).cast("long"))
    sums = moves.groupBy("hostname", "_cell").agg(F.sum("_d").alias("_sum"))
    upto = Window.partitionBy("hostname").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("hostname", "_cell", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("hostname", "_cell").orderBy("_us", "_order", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(moves.withColumn("_inside", F.sum("_d").over(inside)), ahead, ["hostname", "_cell"], "left").where("_row IS NOT NULL")
    return joined.select("_row.*", (F.col("_inside") + F.col("_ahead")).alias(out))


def traffic_totals(requests: DataFrame, seconds: int = WINDOW_SECONDS, minute: int = MINUTE_SECONDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Totals, rates, distinct IPs and errors of every request's window, without the leading IP and endpoint; no Python."""
    cut = materialize(with_cells(requests, max(seconds, minute), group_rows), "requests")
    found = sliding_count(cut, minute, "requests_per_minute")
    found = sliding_count(found, seconds, "total_requests", cut)
    found = sliding_count(found, seconds, "error_requests", cut, F.col("status") >= 400).drop("_m")
    found = sliding_distinct(found, seconds, "ip", "unique_ips")
    return found.withColumn("requests_per_second", F.round(F.col("total_requests") / F.lit(float(max(seconds, 1))), 2))


def _with_cell(requests: DataFrame, span: int) -> DataFrame:
    split = F.col("_m") if "_m" in requests.columns else F.lit(1).cast("long")
    timed = requests.withColumn("_m", split).withColumn("_us", micros("ts"))
    return timed.withColumn("_cell", F.expr(f"(_us * _m - pmod(_us * _m, {span}L)) div {span}L"))


def _place(cell: Column, role: int) -> Column:
    return F.struct(cell.alias("cell"), F.lit(role).alias("role"))


class _Leader:
    """Counts by name in a window, and the name with the highest count; the one seen first wins a tie.

    A request is known by its place in the order of its cell, a name by a number. The heap holds one number per change of
    a name, which sorts by count and then by the place of the name's first request; numbers that no longer hold are passed
    over. What has left the window is dropped now and then, so memory follows the window.
    """

    def __init__(self):
        self.number: dict = {}
        self.names: list = []
        self.count: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.at: list[int] = []  # by place from base on: the name's number, -1 for none
        self.after: list[int] = []  # and the place at which the name comes next
        self.start()

    def start(self) -> None:
        """Begin a new cell."""
        for code in self.at:
            if code >= 0:
                self.count[code] = 0
        self.at, self.after, self.heap = [], [], []
        self.base = self.gone = self.alive = 0
        self.ready = False

    def encode(self, column: pa.Array) -> np.ndarray:
        """The numbers of the names of a batch."""
        if len(self.names) > MAX_NAMES and len(self.names) > 4 * self.alive:
            self.forget()
        coded = column.dictionary_encode(null_encoding="encode")
        numbers = []
        for name in coded.dictionary.to_pylist():
            code = self.number.setdefault(name, len(self.names))
            if code == len(self.names):
                self.names.append(name)
                self.count.append(0)
                self.first.append(0)
                self.last.append(0)
            numbers.append(code)
        return np.array(numbers, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def forget(self) -> None:
        """Drop the names that are in no window any more."""
        kept = [c for c, n in enumerate(self.count) if n]
        moved = dict(zip(kept, range(len(kept))))
        self.at = [moved.get(c, -1) for c in self.at]
        self.names, self.count, self.first, self.last = ([v[c] for c in kept] for v in (self.names, self.count, self.first, self.last))
        self.number = {name: c for c, name in enumerate(self.names)}

    def preload(self, codes: list[int], times: list[int]) -> None:
        """Requests before the cell, or counts of them."""
        for code, n in zip(codes, times):
            self._append(code)
            if code >= 0:
                self.count[code] += n

    def _append(self, code: int) -> None:
        place = self.base + len(self.at)
        self.at.append(code)
        self.after.append(0)
        if code >= 0:
            if self.count[code]:
                self.after[self.last[code] - self.base] = place
            else:
                self.first[code] = place
                self.alive += 1
            self.last[code] = place

    def run(self, codes: list[int], lefts: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Own requests, each with the place at which its window begins: names alive, leading name and its count."""
        count, first, last, at, after, base = self.count, self.first, self.last, self.at, self.after, self.base
        gone, alive = self.gone, self.alive
        if not self.ready or len(self.heap) > 4 * alive + MAX_NAMES:
            self.heap = [first[c] - (count[c] << _SHIFT) for c in {c for c in at[gone - base :] if c >= 0}]
            heapq.heapify(self.heap)
            self.ready = True
        heap, push, pop = self.heap, heapq.heappush, heapq.heappop
        unique, leader, times = [], [], []
        place = base + len(at)
        for code, left in zip(codes, lefts):
            while gone < left:
                c = at[gone - base]
                n = count[c] - 1
                count[c] = n
                if n:
                    f = after[gone - base]
                    first[c] = f
                    push(heap, f - (n << _SHIFT))
                else:
                    alive -= 1
                gone += 1
            n = count[code] + 1
            count[code] = n
            if n == 1:
                first[code] = place
                alive += 1
            else:
                after[last[code] - base] = place
            last[code] = place
            at.append(code)
            after.append(0)
            push(heap, first[code] - (n << _SHIFT))
            while True:
                key = heap[0]
                f, n = key & _PLACE, -(key >> _SHIFT)
                if f >= gone:
                    c = at[f - base]
                    if count[c] == n and first[c] == f:
                        break
                pop(heap)
            unique.append(alive)
            leader.append(c)
            times.append(n)
            place += 1
        self.gone, self.alive = gone, alive
        return unique, leader, times

    def trim(self, base: int) -> None:
        """Drop places that have left the window."""
        del self.at[: base - self.base], self.after[: base - self.base]
        self.base = base


class _WindowScan:
    """One pass over a cell: requests before it, counts of the middle of the window, own requests.

    Totals and errors are differences of running sums. ``minute`` adds the number of requests of a second window, for cells
    without a middle.
    """

    def __init__(self, span: int, minute: int | None = None):
        self.span, self.minute = span, minute

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = {"_ip": _Leader(), "_endpoint": _Leader()}
        skipped = {"_ip": _BY_ENDPOINT, "_endpoint": _BY_IP}
        current = object()
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            role, us, n, error = (col[c].to_numpy() for c in ("role", "_us", "_n", "_error"))
            codes = {c: np.where(role == skipped[c], -1, leaders[c].encode(col[c])) for c in leaders}
            counted = role != _BY_ENDPOINT  # a request in the middle counts once
            weights, errors = n * counted, error * counted
            found: list[list] = []
            for key, start, end in _segments(batch, ["hostname", "cell"]):
                if key != current:
                    current, base, us_at = key, 0, np.empty(0, np.int64)
                    sums = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
                    for leader in leaders.values():
                        leader.start()
                begin = start + int(np.searchsorted(role[start:end], _OWN))
                mine = len(us_at) + begin - start
                us_at = np.concatenate([us_at, us[start:end]])
                sums = [np.concatenate([s, s[-1] + np.cumsum(v[start:end])]) for s, v in zip(sums, (weights, errors))]
                for c, leader in leaders.items():
                    leader.preload(codes[c][start:begin].tolist(), n[start:begin].tolist())
                if begin == end:
                    continue
                upto = np.arange(mine, len(us_at)) + 1
                left = np.searchsorted(us_at, us[begin:end] - self.span)
                total, bad = (s[upto] - s[left] for s in sums)
                lefts = (left + base).tolist()
                unique, ip, ip_n = leaders["_ip"].run(codes["_ip"][begin:end].tolist(), lefts)
                _, endpoint, endpoint_n = leaders["_endpoint"].run(codes["_endpoint"][begin:end].tolist(), lefts)
                names = [[leaders[c].names[code] for code in of] for c, of in (("_ip", ip), ("_endpoint", endpoint))]
                out = [total, unique, names[0], ip_n, names[1], endpoint_n, bad]
                drop = int(left[-1])
                if self.minute is not None:
                    recent = np.searchsorted(us_at, us[begin:end] - self.minute)
                    out.insert(0, upto - recent)
                    drop = min(drop, int(recent[-1]))
                found.append(out)
                if drop > TRIM_ROWS:
                    base, us_at, sums = base + drop, us_at[drop:], [s[drop:] for s in sums]
                    for leader in leaders.values():
                        leader.trim(base)
            own = role == _OWN
            if own.any():
                text = 2 + (self.minute is not None)
                kinds = {text: pa.string(), text + 2: pa.string()}
                arrays = [pa.array([v for part in parts for v in part] if i in kinds else np.concatenate(parts), kinds.get(i, pa.int64())) for i, parts in enumerate(zip(*found))]
                yield pa.RecordBatch.from_arrays([col["_row"].filter(pa.array(own)), *arrays], names=["_row", *[f"c{i}" for i in range(len(arrays))]])


def traffic_windows(requests: DataFrame, seconds: int = WINDOW_SECONDS, minute: int = MINUTE_SECONDS, group_rows: int | None = GROUP_ROWS) -> DataFrame:
    """Window aggregates of every request: totals, rates, distinct and top sources, errors.

    Both windows of a host are one scan. A flooded host, whose windows are split, takes one step for each. The requests
    are parsed once and written, as the search for such hosts reads them too; ``group_rows`` None skips it.
    """
    rest, parts = requests, []
    if group_rows is not None:
        stored = materialize(requests, "requests")
        busy = materialize(busy_hosts(stored, max(seconds, minute), group_rows), "busy-hosts")
        rest = stored
        if not busy.isEmpty():
            cut = with_cells(stored, max(seconds, minute), group_rows, busy)
            rest, split = cut.where("_m = 1").drop("_m"), cut.where("_m > 1")
            per_minute = sliding_count(split, minute, "requests_per_minute")
            parts = [sliding_window(per_minute, seconds, "total_requests", split).drop("_m")]
    counted = sliding_window(rest, seconds, "total_requests", minute=minute)
    for part in parts:
        counted = counted.unionByName(part)
    return counted.withColumn("requests_per_second", F.round(F.col("total_requests") / F.lit(float(max(seconds, 1))), 2))


def with_patterns(
    windows: DataFrame,
    seconds: int = WINDOW_SECONDS,
    request_threshold: int = REQUEST_THRESHOLD,
    ip_threshold: int = IP_THRESHOLD,
    endpoint_threshold: int = ENDPOINT_THRESHOLD,
    min_ips: int = DISTRIBUTED_IPS,
) -> DataFrame:
    """Add patterns_detected: the flood patterns that hold, in rule order."""
    total = F.col("total_requests")

    def text(*parts: str) -> Column:
        """Words in between columns, which have odd positions."""
        return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) if i % 2 else F.lit(c) for i, c in enumerate(parts)])

    per = f" req/{int(seconds)}s)"
    rules = [
        (F.col("top_ip_requests") >= ip_threshold, text("Single IP Flood (", "top_ip", " sent ", "top_ip_requests", per)),
        (
            (total >= request_threshold) & (F.col("unique_ips") >= min_ips),
            text("Distributed DDoS (", "unique_ips", " unique IPs sent ", "total_requests", per),
        ),
        (
            F.col("top_endpoint_requests") >= endpoint_threshold,
            text("Targeted Endpoint Flood (", "top_endpoint", " received ", "top_endpoint_requests", per),
        ),
        (total >= request_threshold * 2, text("Sudden Traffic Spike (", "total_requests", per)),
        (
            (F.col("error_requests") >= request_threshold / 2) & (total > 0),
            text("High HTTP Error Rate (", "error_requests", " error responses in window)"),
        ),
    ]
    found = windows.withColumn("patterns_detected", F.array_compact(F.array(*[F.when(c, words) for c, words in rules])))
    return evaluate_once(found, "patterns_detected")


def with_risk(patterns: DataFrame, request_threshold: int = REQUEST_THRESHOLD, ip_threshold: int = IP_THRESHOLD) -> DataFrame:
    """Add risk_level and is_anomaly."""
    found, total = F.size("patterns_detected"), F.col("total_requests")
    risk = (
        F.when(found == 0, "NORMAL")
        .when((total >= request_threshold * 2) | (found >= 2), "CRITICAL")
        .when((total >= request_threshold) | (F.col("top_ip_requests") >= ip_threshold), "HIGH")
        .otherwise("SUSPICIOUS")
    )
    return patterns.withColumn("risk_level", risk).withColumn("is_anomaly", F.col("risk_level").isin("HIGH", "CRITICAL"))


def traffic_report(
    requests: DataFrame,
    seconds: int = WINDOW_SECONDS,
    request_threshold: int = REQUEST_THRESHOLD,
    ip_threshold: int = IP_THRESHOLD,
    endpoint_threshold: int = ENDPOINT_THRESHOLD,
    min_ips: int = DISTRIBUTED_IPS,
    minute: int = MINUTE_SECONDS,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """The full traffic report of every request."""
    windows = traffic_windows(requests, seconds, minute, group_rows)
    patterns = with_patterns(windows, seconds, request_threshold, ip_threshold, endpoint_threshold, min_ips)
    return with_risk(patterns, request_threshold, ip_threshold)


def traffic_snapshot(
    requests: DataFrame,
    as_of: Column,
    seconds: int = WINDOW_SECONDS,
    request_threshold: int = REQUEST_THRESHOLD,
    ip_threshold: int = IP_THRESHOLD,
    endpoint_threshold: int = ENDPOINT_THRESHOLD,
    min_ips: int = DISTRIBUTED_IPS,
    minute: int = MINUTE_SECONDS,
) -> DataFrame:
    """The report of each host as of one time, without a new request. Hosts silent for the whole horizon have no row."""
    # A plain range on ts, so that files and partitions outside it are not read.
    horizon = max(seconds, minute)
    recent = requests.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.expr(f"INTERVAL {horizon} SECONDS")))
    recent = evaluate_once(recent.withColumn("_age", micros(as_of) - micros("ts")), "_age")
    in_window, in_minute = F.col("_age") <= seconds * 1_000_000, F.col("_age") <= minute * 1_000_000
    weigh = [F.count_if(in_window).alias("n"), F.min(F.when(in_window, F.struct("ts", "seq"))).alias("first")]

    def leader(name: str) -> DataFrame:
        counted = recent.groupBy("hostname", name).agg(*weigh).where(F.col("n") > 0)
        # Most frequent, then first seen: the smallest (-n, first).
        best = F.min(F.struct((-F.col("n")).alias("m"), F.col("first"), F.col(name).alias("name"))).alias("best")
        return counted.groupBy("hostname").agg(best, F.count(F.lit(1)).alias("distinct")).select(
            "hostname", F.col("best.name").alias(f"top_{name}"), (-F.col("best.m")).alias(f"top_{name}_requests"), F.col("distinct").alias(f"unique_{name}s")
        )

    totals = recent.groupBy("hostname").agg(
        F.count_if(in_window).alias("total_requests"),
        F.count_if(in_minute).alias("requests_per_minute"),
        F.count_if(in_window & (F.col("status") >= 400)).alias("error_requests"),
    )
    report = (
        totals.join(leader("ip"), "hostname", "left")
        .join(leader("endpoint").drop("unique_endpoints"), "hostname", "left")
        .na.fill("N/A", ["top_ip", "top_endpoint"])
        .na.fill(0, ["top_ip_requests", "unique_ips", "top_endpoint_requests"])
        .withColumn("requests_per_second", F.round(F.col("total_requests") / F.lit(float(max(seconds, 1))), 2))
    )
    patterns = with_patterns(report, seconds, request_threshold, ip_threshold, endpoint_threshold, min_ips)
    return with_risk(patterns, request_threshold, ip_threshold)
