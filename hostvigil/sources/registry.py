"""Versions of a naive Bayes model, kept as counts that add up, and of models that are saved as files."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.operators import classify
from hostvigil.session import materialize
from hostvigil.sources.stored import Conflict, Versions


class ModelRegistry(Versions):
    """A model below ``path``. A version names a folder of counts, the datasets that are in it and the digits of its tokens.

    Retraining adds the counts of new rows to those of the newest version, so old rows are not read again, and the result
    is the model that a fit over all rows would give. A dataset is added once: its name is part of the version. A version is
    created once, so of two writers one gets Conflict, and readers always find a whole model.
    """

    def add(self, rows: DataFrame, dataset: str, digits: int | None = None) -> int:
        """Count labelled rows (text, label) into a new version; rows without a label or text do not count."""
        version = self.version()
        now = self.manifest(version) or {"datasets": [], "digits": digits, "folder": None}
        if dataset in now["datasets"]:
            return version
        if now["digits"] != digits:
            raise ValueError(f"the model counts tokens of {now['digits']} digits, not {digits}")
        known = rows.where("label IS NOT NULL AND text IS NOT NULL").select("label", "text")
        words = known.select("label", F.explode(classify.features(F.col("text"), digits)).alias("token"))
        tokens = words.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
        classes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        folder = f"{self.path}/counts-{uuid.uuid4().hex}"
        for name, counts, keys in (("tokens", tokens, ["token", "label"]), ("classes", classes, ["label"])):
            if now["folder"]:
                counts = counts.unionByName(self._counts(now["folder"], name)).groupBy(*keys).agg(F.sum("n").alias("n"))
            counts.write.parquet(f"{folder}/{name}")
        made = {"datasets": [*now["datasets"], dataset], "digits": digits, "folder": folder}
        if not self._commit(version + 1, made):
            raise Conflict(f"version {version + 1} of {self.path} was made by another writer")
        return version + 1

    def _counts(self, folder: str, name: str) -> DataFrame:
        schema = {"tokens": "token STRING, label STRING, n BIGINT", "classes": "label STRING, n BIGINT"}[name]
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def load(self, version: int | None = None) -> tuple[list[str], DataFrame]:
        """Labels and (token, logp) of a version, the newest by default, as classify.nb_score takes them."""
        found = self.manifest(version)
        if not found:
            raise ValueError(f"no version {version or ''} of a model in {self.path}")
        classes = {r.label: r.n for r in self._counts(found["folder"], "classes").collect()}
        labels = sorted(classes)
        tokens = self._counts(found["folder"], "tokens")
        counts = tokens.groupBy("token").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("label") == name, F.col("n"))), F.lit(0)) for name in labels]).alias("counts"))
        return labels, materialize(classify.nb_from_counts(materialize(counts, "token-counts"), [classes[name] for name in labels]), "registered-model")

    def attach(self, model: PipelineModel, version: int | None = None) -> str:
        """Save a fitted pipeline next to a version."""
        path = f"{self.path}/pipeline-{version or self.version()}"
        model.write().save(path)
        return path

    def attached(self, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/pipeline-{version or self.version()}")
