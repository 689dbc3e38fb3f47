"""Session helpers: configuration, reliable lineage cuts and shared scratch space."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tropicast", **conf) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a folder inside the warehouse, which all executors share too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tropicast-scratch"
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path in this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/tropicast-{app}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Nothing is recomputed when an executor is lost, and the plan that follows starts from
    the true size of the table, which a checkpointed plan in a loop would not.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings for the jobs run inside; put back after."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of at most ``rows`` rows between Spark and Python for the jobs run inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    return _settings(spark, {key: str(min(rows, before) if before > 0 else rows)})


def bloom_filtered(spark: SparkSession):
    """Spark's runtime Bloom filters for tables of any size: a shuffled join inside reads the keys of a filtered table first and shuffles
    of the other side only rows whose key may be among them. The join itself decides, so results are the same.
    """
    key = "spark.sql.optimizer.runtime.bloomFilter"
    return _settings(spark, {f"{key}.enabled": "true", f"{key}.applicationSideScanSizeThreshold": "0", f"{key}.creationSideThreshold": "4g"})


def freed_shuffles(spark: SparkSession):
    """Shuffle files of frames made and run inside are deleted as each run ends, not when the driver next collects its garbage.

    For frames that run once: if one runs again, its shuffles are made anew.
    """
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once nothing will read it again."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("cut-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
