"""Shared-folder checkpoints: intermediate tables that survive the loss of executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidArgument
from .session import ship


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all executors
    are threads of this process (tests), a new local one, set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="presencekit-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a Python worker. Both sides hold a few at a time, so this bounds their
#: memory whatever the length of the texts.
BATCH = 8 << 20
#: Set while a table is written: the files of its shuffles go as soon as it is there, not when the driver's collectors have run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables under the shared folder; ``drop`` deletes those no longer read. Sets the session's Arrow batch size."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        self.spark, self.base = spark, f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back with its schema: a cut in the lineage. No shuffle file of the writing stays."""
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, was)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        r = self.spark.read
        return (r.schema(schema) if schema is not None else r).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes the tables ``names``; all tables if none is named."""
        jvm = self.spark._jvm
        for n in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self, *names: str) -> None:
        """Drops ``names`` (none: no table) and lets Spark delete the shuffle files of plans that nothing refers to any
        more, which it does when the driver's collectors have run."""
        if names:
            self.drop(*names)
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
