"""Written intermediate tables: they cut lineage and survive the loss of an executor.

Shuffle files of the job that writes a table go when it is written, not when the driver happens to collect its garbage.

The folder is the one the cluster names in ``spark.checkpoint.dir``, which all executors share.  Only where that
setting is absent and the master is local (tests, a laptop) a local temporary folder stands in, removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
#: Spark's setting by which a finished job's shuffle files are deleted
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or for a local master one temporary folder per process; a cluster without one is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not _FALLBACK:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="threadmoss-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _FALLBACK.append("file://" + folder)
    return _FALLBACK[0]


class Scratch:
    """A folder of written tables for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/threadmoss/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write the table once and return it as read back."""
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            writer.parquet(self.path(name))
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        if like is not None:
            reader = reader.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads, or all tables of the run once its results are stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self, *names: str) -> None:
        """Delete several tables; a * stands for any characters."""
        for name in names:
            pattern = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            files = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in files.globStatus(pattern) or ():
                files.delete(found.getPath(), True)
