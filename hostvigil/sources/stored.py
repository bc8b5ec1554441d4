"""Tables by date that can be changed where they are stored: folders are never altered, a manifest says which count."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvigil.operators import alerts as a
from hostvigil.operators import incidents, review
from hostvigil.session import delete, materialize
from hostvigil.sources import files

Manifest = dict[str, dict[str, int]]  # date -> load -> rows
WAIT_SECONDS = 30


class Conflict(Exception):
    """Another writer has changed the same dates meanwhile."""


class Versions:
    """Numbered JSON documents below ``path``, each created once: the newest one says what counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        store, at = self._file(path)
        return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []

    def _begun(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self) -> int:
        """The newest version; 0 before the first. One that another writer is just creating is waited for."""
        newest = max(self._begun(), default=0)
        until = time.monotonic() + WAIT_SECONDS
        while newest and self._load(newest) is None:
            if time.monotonic() > until:
                raise Conflict(f"version {newest} of {self.path} was begun and not finished; delete its file if its writer is gone")
            time.sleep(0.2)
        return newest

    def _load(self, version: int) -> Manifest | None:
        """The manifest of a version; None while it is being written."""
        row = self.spark.read.text(f"{self.path}/_versions/{version:08d}.json", wholetext=True).first()
        try:
            return json.loads(row.value) if row else None
        except ValueError:
            return None

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        return (self._load(version) or {}) if version else {}

    def _commit(self, version: int, manifest: Manifest) -> bool:
        """Create the file of a version; False if it is there already."""
        store, at = self._file(f"{self.path}/_versions/{version:08d}.json")
        try:
            out = store.create(at, False)
        except Py4JJavaError as error:
            if store.exists(at):
                return False
            raise error
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        return True


class StoredTable(Versions):
    """A table with a column dt (date) below ``path``.

    Rows are written into new folders (load=<id>/dt=<date>). A version is a small JSON file that lists, for each date,
    the folders that count and how many rows each has; it is created only if no other writer has created that number. So
    a reader sees one version whole, the old or the new one, and a writer that fails half-way leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path)
        self.schema = T.StructType.fromDDL(schema)
        fields = [f for f in self.schema.fields if f.name != "dt"]
        self.stored = T.StructType([*fields, T.StructField("load", T.StringType()), T.StructField("dt", T.DateType())])

    def _change(self, added: Manifest, replaced: Manifest | None = None) -> int:
        """Add folders to the newest version, in place of ``replaced`` ones, which must still be those that count."""
        while True:
            version = self.version()
            now = self.manifest(version)
            for date, loads in (replaced or {}).items():
                if now.get(date) != loads:
                    raise Conflict(f"rows of {date} have changed since they were read")
                del now[date]
            for date, loads in added.items():
                now[date] = {**now.get(date, {}), **loads}
            if self._commit(version + 1, now):
                return version + 1

    # --- rows ---
    def _write(self, rows: DataFrame) -> Manifest:
        """Write rows to new folders, and count them there."""
        load = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.partitionBy("dt").parquet(f"{self.path}/load={load}")
        made = self.spark.read.schema(self.stored).option("basePath", self.path).parquet(f"{self.path}/load={load}")
        counts = made.groupBy(F.col("dt").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a date
        return {row.date: {load: row.n} for row in counts if row.date is not None}

    def _rows(self, chosen: Manifest) -> DataFrame:
        paths = [f"{self.path}/load={load}/dt={date}" for date, loads in chosen.items() for load in loads]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.stored).option("basePath", self.path).parquet(*paths).select(*self.schema.names)

    def append(self, rows: DataFrame) -> int:
        """Add rows; the number of the new version. Rows without a date are refused."""
        stored = materialize(rows, "to-append")
        if stored.where("dt IS NULL").limit(1).count():
            raise ValueError("rows of a stored table need a date")
        return self._change(self._write(stored))

    def read(self, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """The rows of a version (default: the newest) of the dates from ``since`` to ``until``; no other folder is opened."""
        chosen = {d: loads for d, loads in self.manifest(version).items() if (since is None or d >= since) and (until is None or d <= until)}
        return self._rows(chosen)

    def update(self, changes: DataFrame, key: str = "id") -> int:
        """Set columns of rows by key: ``changes`` holds key, dt, and new values of other columns; null values count.

        Only the dates of the changes are read and written anew; the version number comes back. Keys that are not there
        change nothing. If another writer has changed one of these dates meanwhile, Conflict is raised and nothing happens.
        """
        changes = materialize(changes, "changes")
        dates = [r.date for r in changes.select(F.col("dt").cast("string").alias("date")).distinct().collect()]
        touched = {d: loads for d, loads in self.manifest().items() if d in dates}
        if not touched:
            return self.version()
        values = [c for c in changes.columns if c not in (key, "dt")]
        new = changes.select(F.col(key).alias("_key"), F.col("dt").alias("_dt"), F.struct(*values).alias("_new"))
        old = self._rows(touched)
        joined = old.join(new, (old[key] == new["_key"]) & (old["dt"] == new["_dt"]), "left")
        hit = F.col("_key").isNotNull()
        out = joined.select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(old[c]).alias(c) if c in values else old[c] for c in self.schema.names])
        return self._change(self._write(out), touched)

    def newest(self, n: int, where: Column | None = None, order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
        """The ``n`` newest rows. Dates are opened from the newest on, as many as hold enough rows by the manifest.

        With a condition, more dates are opened, twice as many each time, until enough of their rows meet it.
        """
        manifest = self.manifest()
        dates = sorted(manifest, reverse=True)
        size, taken = 0, 0
        while taken < len(dates) and size < n:
            size += sum(manifest[dates[taken]].values())
            taken += 1
        chosen = self._rows({d: manifest[d] for d in dates[:taken]})
        if where is not None:
            while taken < len(dates) and chosen.where(where).limit(n).count() < n:
                taken = min(len(dates), 2 * taken)
                chosen = self._rows({d: manifest[d] for d in dates[:taken]})
            chosen = chosen.where(where)
        return chosen.orderBy(*[F.desc(c) for c in order]).limit(n)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions and the folders that only they name; the number of loads deleted."""
        newest = self.version()
        kept = {load for v in range(max(1, newest - keep + 1), newest + 1) for loads in self.manifest(v).values() for load in loads}
        old = {load for v in self._begun() if v <= newest - keep for loads in self.manifest(v).values() for load in loads} - kept
        delete(self.spark, *[f"{self.path}/load={load}" for load in old], *[f"{self.path}/_versions/{v:08d}.json" for v in range(1, newest - keep + 1)])
        return len(old)


# --- incident tables ---
def incident_table(spark: SparkSession, root: str, table: str) -> StoredTable:
    return StoredTable(spark, f"{root}/{table}", f"id STRING, seq BIGINT, {files.TABLES[table]}, dt DATE")


def append_incidents(rows: DataFrame, root: str, table: str) -> int:
    return incident_table(rows.sparkSession, root, table).append(files.table_rows(rows, table))


def recent_incidents(spark: SparkSession, root: str, limit: int = 50, min_risk: str | None = None) -> DataFrame:
    """Newest stored incidents at or above a risk; an unknown level filters nothing."""
    return incident_table(spark, root, "attack_logs").newest(limit, incidents.at_least(min_risk))


def recent_decisions(spark: SparkSession, root: str, limit: int = 50, decision: str | None = None) -> DataFrame:
    return incident_table(spark, root, "security_decisions").newest(limit, F.col("decision") == decision if decision else None)


def resolve_alerts(spark: SparkSession, root: str, recoveries: DataFrame) -> int:
    """Close stored resource alerts: each ACTIVE one by the first later recovery (hostname, metric, ts, seq) of its metric.

    Only the dates of alerts that are closed are written anew.
    """
    table = incident_table(spark, root, "alerts")
    metric = F.regexp_extract("alert_type", "^(.+)_(?:HIGH|CRITICAL)$", 1)
    active = table.read().where((F.col("status") == "ACTIVE") & (metric != ""))
    open_alerts = active.select("id", "dt", "hostname", metric.alias("metric"), F.col("timestamp").alias("ts"), "seq")
    closed = a.resolve_alerts(open_alerts, recoveries).where("resolved_at IS NOT NULL")
    return table.update(closed.select("id", "dt", "status", "resolved_at"))


REVIEWS = files.REVIEW_SCHEMA + ", dt DATE"


def review_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/reviews", REVIEWS)


def queue_reviews(rows: DataFrame, root: str) -> int:
    return review_table(rows.sparkSession, root).append(rows.withColumn("dt", F.to_date("timestamp")))


def apply_reviews(spark: SparkSession, root: str, verdicts: DataFrame) -> int:
    """Write verdicts (id, review_seq, action, label) into the stored queue; only the dates of reviewed rows are written."""
    table = review_table(spark, root)
    queue = table.read()
    reviewed = queue.join(verdicts.select("id").distinct(), "id", "left_semi")
    return table.update(review.apply_reviews(reviewed, verdicts).select("id", "dt", "status", "reviewed_label"))
