"""Log lines from text files, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.functions.text import strip

# The files a host is watched on unless told otherwise.
DEFAULT_SOURCES = [
    "/var/log/auth.log",
    "/var/log/secure",
    "/var/log/syslog",
    "/var/log/messages",
    "/var/log/nginx/access.log",
    "/var/log/nginx/error.log",
    "/var/log/apache2/access.log",
    "/var/log/apache2/error.log",
    "/var/log/httpd/access_log",
    "/var/log/httpd/error_log",
    "/var/log/fail2ban.log",
    "/var/log/audit/audit.log",
]


def _lines(text: DataFrame) -> DataFrame:
    """Decode with replacement, strip, drop blanks, and tag each line with the path of its file."""
    line = strip(F.make_valid_utf8("value"))
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    return text.select(path.alias("source_log"), line.alias("raw_line")).where("raw_line <> ''")


def read_log_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines end with LF, CRLF or CR."""
    return _lines(spark.read.text(list(paths)))


def stream_log_lines(spark: SparkSession, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    """New segment files below a directory; the checkpoint remembers what was read, new files may appear any time."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _lines(reader.load(directory))


def spread(frame: DataFrame) -> DataFrame:
    """Use all cores on input that arrives in fewer partitions than there are cores, such as one small file.

    Larger input is left as it is, so no shuffle is added at scale.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
