"""Streams that outlive their driver: folders named by the caller, batches stored by id, readers that see whole batches."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from hostvigil.session import delete

Sink = Callable[[DataFrame, int], None]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A batch stores what it has changed in its state, not the whole state, and no key is looked up just to count them.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@dataclass(frozen=True)
class Place:
    """Where a stream keeps its offsets and state, and where its rows go. The same place is the same stream."""

    root: str
    name: str

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_checkpoints/{self.name}"

    @property
    def data(self) -> str:
        return f"{self.root}/{self.name}"


def stream_session(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of its own for a stream, with the settings of ``spark``, state in RocksDB, and ``conf``.

    A query takes the settings of its session when it starts, so other streams never see what this one needs.
    """
    child = spark.newSession()
    for row in spark.sql("SET").collect():
        if spark.conf.isModifiable(row.key):
            child.conf.set(row.key, row.value)
    for key, value in {**STATE, **conf}.items():
        child.conf.set(key, value)
    return child


def start(stream: DataFrame, place: Place, sink: Sink | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a stream at its place, or go on where it stopped there.

    Each micro-batch goes to ``sink(batch, batch_id)``, or below its id into the place's data. A driver that is lost in
    the middle of a batch gets the same rows again under the same id, so a sink that overwrites what it wrote under an id
    loses and doubles nothing. ``every`` is the interval of a stream that goes on; without it the stream takes what is
    there and ends.
    """
    stored = sink or (lambda batch, n: batch.write.mode("overwrite").parquet(f"{place.data}/batch={n}"))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place.checkpoint).foreachBatch(stored)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def committed(spark: SparkSession, place: Place) -> int:
    """The id of the last batch that has ended; -1 before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place.checkpoint}/commits")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def read(spark: SparkSession, place: Place, schema: str, upto: int | None = None) -> DataFrame:
    """The rows of all batches that have ended, with their batch id; a batch that is being written is not seen."""
    last = committed(spark, place) if upto is None else upto
    if last < 0:
        return spark.createDataFrame([], f"{schema}, batch BIGINT")
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(place.data).where(F.col("batch") <= last)


class KeyedTimes:
    """The last time of each key, kept next to a stream: a small table of the changed keys for each batch.

    Every ``merge`` batches the table holds all keys that may still matter, and older tables go. A batch reads only what
    earlier batches left, so a batch that runs again finds the times it found before.
    """

    def __init__(self, root: str, keys: str, merge: int = 20):
        self.root, self.merge = root, merge
        self.schema = f"{keys}, ts TIMESTAMP_NTZ"
        self.keys = [k.strip().split(" ")[0] for k in keys.split(",")]

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if not batch_id:
            return spark.createDataFrame([], self.schema)
        first = (batch_id - 1) // self.merge * self.merge
        rows = spark.read.schema(f"{self.schema}, batch BIGINT").parquet(self.root).where(F.col("batch").between(first, batch_id - 1))
        return rows.groupBy(*self.keys).agg(F.max("ts").alias("ts"))

    def write(self, changed: DataFrame, batch_id: int, oldest=None) -> None:
        """Keep the times of (keys, ts) rows; a merged table leaves out keys last seen before ``oldest``, if that is given."""
        spark, rows = changed.sparkSession, changed.select(*self.keys, "ts")
        if batch_id % self.merge == 0:
            rows = rows.unionByName(self.before(spark, batch_id))
            rows = rows if oldest is None else rows.where(F.col("ts") >= F.lit(oldest))
        rows.groupBy(*self.keys).agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        if batch_id % self.merge == 0:
            delete(spark, *[f"{self.root}/batch={n}" for n in range(max(0, batch_id - 2 * self.merge), batch_id - self.merge)])


class CounterLog(StreamingQueryListener):
    """Counters that batches observe on their way (DataFrame.observe), by query and batch; no second pass over rows.

    A batch that runs again replaces its counters. A sink must read its batch once, or rows count twice.
    """

    def __init__(self, name: str):
        self.name, self.by_batch, self.ended = name, {}, set()
        self.news = threading.Condition()

    def observe(self, stream: DataFrame, **counters: Column) -> DataFrame:
        return stream.observe(self.name, *[c.alias(k) for k, c in counters.items()])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows:
            with self.news:
                self.by_batch[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Events come a little after their query: wait until that of its end is here."""
        with self.news:
            if not self.news.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError(f"no end of query {query.runId} within {seconds} seconds")

    def totals(self) -> dict[str, int]:
        with self.news:
            rows = list(self.by_batch.values())
        return {k: sum(r[k] or 0 for r in rows) for k in (rows[0] if rows else {})}
