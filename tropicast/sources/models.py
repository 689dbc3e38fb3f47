"""A durable table of trained models, one row per (model, lead, fold), to resume an interrupted training from.

Every append is a folder of its own that is written under a hidden name and then renamed, so a run that is
killed leaves either all models of an append or none, and readers never see a half-written one. Two runs that train the same task
both append it; readers take the earlier append.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folds import open_tasks

KEYS = ("lead", "fold")


class ModelRegistry:
    """Models below ``path``, any folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _appends(self) -> list[str]:
        fs, root = self._fs(), self._folder(".")
        if not fs.exists(root):
            return []
        return sorted(str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("append-"))

    def append(self, models: DataFrame, model: str) -> None:
        """Add models (one or more rows per task) under a model's name, all or none of them."""
        number, token = len(self._appends()), uuid.uuid4().hex
        hidden, final = self._folder(f"_writing-{token}"), self._folder(f"append-{number:08d}-{token}")
        rows = models.withColumns({"model": F.lit(model), "append": F.lit(f"{number:08d}-{token}")})
        rows.write.parquet(str(hidden))
        if not self._fs().rename(hidden, final):
            raise OSError(f"{hidden} cannot be renamed")

    def models(self, model: str) -> DataFrame | None:
        """All rows of a model, of the earliest append per task; None where nothing is stored."""
        found = self._appends()
        if not found:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*found).where(F.col("model") == model)
        first = F.min("append").over(Window.partitionBy(*KEYS))
        return rows.withColumn("_first", first).where(F.col("append") == F.col("_first")).drop("_first")

    def open(self, tasks: DataFrame, model: str) -> DataFrame:
        """Tasks (lead, fold) without a stored model."""
        stored = self.models(model)
        return tasks if stored is None else open_tasks(tasks, stored, KEYS)

    def train(self, tasks: DataFrame, model: str, learner: Callable[[DataFrame], DataFrame], leads: Iterable[int]) -> int:
        """Train the open tasks of one lead after the other and store them; the number of tasks trained.

        ``learner`` gets the open tasks (lead, fold) and returns their models. A run that is killed loses the lead it was at.
        """
        trained = 0
        for lead in leads:
            todo = self.open(tasks.where(F.col("lead") == lead), model).select(*KEYS).distinct()
            n = todo.count()
            if n:
                self.append(learner(todo), model)
                trained += n
        return trained
