"""One run of a plan: its stages written once, so that a stage that isn't repeatable is evaluated once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the files of a query's shuffles go with its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see; a temporary folder where it is unset and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-run-")
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Run:
    """A folder with a table for each stage.

    keep(df, name) evaluates df once, writes it and reads it back: whatever is planned on what it gives
    sees the same rows, however often it is used, and tasks that are repeated after an executor was lost
    read files instead of asking again. A run that is given the name of an earlier one goes on where that
    one ended: stages that were committed are read, all others written anew. Without a name the run's
    folder is removed at exit.

    Stages are compressed well, and a stage's shuffles are removed once it is written, so that what a run
    needs of disks is what its stages hold and the shuffles of one of them.
    """

    def __init__(self, spark: SparkSession, run_id: str | None = None, folder: str | None = None) -> None:
        self.spark, self.run_id = spark, run_id or uuid.uuid4().hex[:12]
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/run-{self.run_id}"
        self.stages: dict[str, DataFrame] = {}
        if run_id is None:
            atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.stages:
            path = f"{self.folder}/{name}"
            if not self.has(name):
                before = self.spark.conf.get(CLEANUP, None)
                self.spark.conf.set(CLEANUP, "true")
                try:
                    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
                finally:
                    self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
            self.stages[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.stages[name]

    def has(self, name: str) -> bool:
        """Whether the stage was written whole, by this run or by the one that it goes on with."""
        fs, done = file_system(self.spark, f"{self.folder}/{name}/_SUCCESS")
        return fs.exists(done)

    def kept(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """keep(make(), name), without a call of make where the stage is there already."""
        if name not in self.stages and self.has(name):
            self.stages[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self.stages[name] if name in self.stages else self.keep(make(), name)

    def release(self, name: str) -> None:
        """Remove a stage that no later one reads; tables that read it can't be used any more."""
        self.stages.pop(name, None)
        fs, path = file_system(self.spark, f"{self.folder}/{name}")
        fs.delete(path, True)

    def drop(self) -> None:
        """Remove the run's tables; quiet where the session has ended."""
        try:
            fs, path = file_system(self.spark, self.folder)
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  at exit the session may be gone
            pass
