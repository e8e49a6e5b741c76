"""Runs on disk: fitted models, parameters and history as tables keyed by run id."""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = "run_id string, name string, version bigint, settings string"


class RunStore:
    """A folder shared by the cluster with one sub-folder per model and append-only tables beside them."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save_model(self, name: str, model: PipelineModel) -> None:
        model.write().overwrite().save(self._path(f"{self.run_id}/models/{name}"))

    def load_model(self, name: str) -> PipelineModel:
        return PipelineModel.load(self._path(f"{self.run_id}/models/{name}"))

    def save_settings(self, name: str, settings: dict) -> None:
        """A new version; earlier ones stay."""
        row = [(self.run_id, name, time.time_ns(), json.dumps(settings, sort_keys=True))]
        self.spark.createDataFrame(row, _SETTINGS).write.mode("append").json(self._path("settings"))

    def settings(self) -> DataFrame:
        """The newest version of each of the run's settings."""
        rows = self.spark.read.schema(_SETTINGS).json(self._path("settings")).where(F.col("run_id") == self.run_id)
        return rows.groupBy("run_id", "name").agg(F.max("version").alias("version"), F.max_by("settings", "version").alias("settings"))

    def setting(self, name: str) -> dict:
        """One of them, read back."""
        row = self.settings().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(f"run {self.run_id} has no settings {name}")
        return json.loads(row.settings)

    def save_history(self, trials: DataFrame) -> None:
        trials.withColumn("run_id", F.lit(self.run_id)).withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(self._path("history"))

    def history(self) -> DataFrame:
        """Trials of all sessions, each with the version that it was saved in: a search is resumed by adding trials with another seed."""
        return self.spark.read.parquet(self._path("history")).where(F.col("run_id") == self.run_id)
