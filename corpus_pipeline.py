"""Corpus pipeline: quality, near-duplicates, contamination, personal data and mixing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm import decontaminate, mixing, pii, quality, simhash
from hostvigil.llm.common import fold_of, named, table
from hostvigil.session import delete, new_path, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled rows of ``docs``.

    A null text counts as empty. Without labelled rows of both kinds all documents score alike; an empty table stays
    empty, and repeated rows are judged alike.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality.train(docs.select("doc_id", "text"), labels, fold_of(F.col("key"), 5) != 0)
    plain = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"), named("text").alias("text"))
    return quality.score(plain, net).where("predicted = 1").select("doc.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of equal ids one, null ids last.

    Null, empty and blank texts have no words: they are one group.
    """
    return simhash.keep_one_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``; null and empty texts are clean, and so is all without items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    plain = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"), named("text").alias("text"))
    return decontaminate.search_benchmark(plain, items).where(~F.col("contaminated")).select("doc.*")


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by placeholders; n_chars follows the text. Null texts stay null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of words taken.

    Documents without words are never taken; a null source is a source; repeated rows are mixed as rows.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("mixing", mixed),
]

# The stages fit models and follow links, which SQL does not express; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's input.

    What a stage has stored on its way goes as soon as its result is written, and so does its input: the working folder
    holds one stage's tables at a time.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
