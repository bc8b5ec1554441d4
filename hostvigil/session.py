"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Cluster sizes (executors, memory) stay with the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)  # paths given out in the innermost scratch()


def build_session(app: str = "hostvigil", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Shared folder for written tables and streaming checkpoints, one per application.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and executors are one process,
    gets a temporary folder of its own if that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = _LOCAL_ROOTS.get(spark.sparkContext.applicationId)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = _LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="hostvigil-"))
    return f"{root.rstrip('/')}/hostvigil-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the working folder that no other run uses."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders of any store that Spark reads; what is not there is passed over."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediates that the block has written when it ends; its results must be stored by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        delete(spark, *made)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application wrote to its working folder. For the end of a job, when its results are stored."""
    delete(spark, work_root(spark))


def materialize(frame: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Steps that read it several times do not compute it again, and a lost executor costs no more than its own tasks.
    """
    path = new_path(frame.sparkSession, name)
    writer = frame.write.partitionBy(*partitions) if partitions else frame.write
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
