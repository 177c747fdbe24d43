"""Session defaults shared by tests, the bench and the command line."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "marram") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A temporary one is set only in local mode with none configured; on a cluster a missing
    setting is an error, for a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="marram-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Workspace:
    """Tables written to the shared folder while an iterative job runs; ``drop`` removes what is done with.

    What a result still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.folders = spark, {}, []
        atexit.register(self._close)

    def _close(self) -> None:
        if SparkContext._active_spark_context is not None:
            self.drop_all_but()
            for path in self.folders:
                self._remove(path)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def folder(self) -> str:
        """A folder of its own for files that are read until the application ends; writers make it."""
        self.folders.append(f"{shared_folder(self.spark)}/work-{uuid.uuid4().hex}")
        return self.folders[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: its lineage ends there, whichever executor is lost."""
        path = f"{shared_folder(self.spark)}/work-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path is not None:
                self._remove(path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t, _ in list(self.paths.values()) if all(t is not k for k in tables)])
