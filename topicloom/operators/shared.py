"""The folder that all executors share, and tables in it that a job needs for a while."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs in one process (tests).
LOCAL_DIR = "/tmp/topicloom-shared"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A session in one process may leave it unset; a cluster may not."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL_DIR
    return found.rstrip("/")


def checkpoint(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; its files go when nothing refers to them, unless the session says otherwise."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(rows.sparkSession))
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return rows.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


class Scratch:
    """Parquet tables that go with close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        remove(self.spark, f"{self.root}/{name}".rstrip("/"))
