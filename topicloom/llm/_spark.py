"""Session helpers shared by the operators: scratch tables, lineage cuts, arrow batch size."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that a task hands to Python at once; texts are long, so fewer than Spark's default.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Used only where the session names no spark.checkpoint.dir and runs in one process (tests).
LOCAL_DIR = "/tmp/topicloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A session in one process may leave it unset; a cluster may not."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow task that at its end gives freed memory back to the system; its Python worker lives on and would keep it."""

    @functools.wraps(task)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


#: Bytes of a stored table to a task where an operator deals rows out itself, if the session's number of partitions gives larger tasks.
TASK_BYTES = 32 << 20


def partitions(spark: SparkSession, table: DataFrame | None = None) -> int:
    """The session's number of shuffle partitions, or more where table's size asks for it (files: their size; unknown: ignored)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if table is None:
        return n
    size = float(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, int(size // TASK_BYTES) + 1) if size < 2**60 else n


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder, so a lost executor costs nothing.

    Its files go when nothing refers to the table any more, unless the session says otherwise.
    """
    shared_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that one operator run needs for a while."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str | None = None) -> None:
        """Deletes a table, or all, and lets the cleaner remove shuffle files that nothing refers to any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    import gc

    gc.collect()
    spark._jvm.System.gc()


def text_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Columns that tell rows apart: equal rows share a key, a null id counts as the largest."""
    return [
        F.coalesce(F.col(doc_id), F.lit(2**63 - 1)).cast("long").alias("_id"),
        F.xxhash64(F.col(text)).alias("_th"),
    ]


#: Ids up to this many are sent to all tasks to thin a table before its shuffle (8 bytes each); more are joined without.
THIN_IDS = 500_000


def thinned(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """rows with the ids only; the join that follows does the same, so this saves shuffled text and nothing else."""
    ids = cut(ids.select(F.col(id_column).alias("_want")).distinct())
    if ids.count() > THIN_IDS:
        return rows
    return rows.join(F.broadcast(ids), F.col(key) == F.col("_want"), "left_semi")


def without(docs: DataFrame, keys: list, gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys (columns of docs) are a row of gone; all columns stay, whatever their names."""
    gone = cut(gone.toDF(*[f"_g{i}" for i in range(len(keys))]).distinct())
    hint = F.broadcast(gone) if gone.count() <= THIN_IDS else gone
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(f"_k{i}") == F.col(f"_g{i}") for i in range(len(keys))]
    return packed.join(hint, same, "left_anti").select("row.*")
