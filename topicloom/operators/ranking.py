"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.shared import checkpoint


def row_numbers(df: DataFrame, key: str, name: str = "row_number", ties: list[Column] | None = None) -> DataFrame:
    """df with 1, 2, ... in the order of a numeric key: ranges between quantiles, numbered each by itself, plus what lies before.

    A null key comes first. The quantiles (one per shuffle partition) and the ranges' sizes are all that leaves the tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    step = max(1, round(len(bounds) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array(F.lit(0).cast(df.schema[key].dataType))
    k = F.col(f"`{key}`")
    coarse = F.size(F.filter(longs(bounds[step - 1 :: step]), lambda b: b < k)) if bounds else F.lit(0)
    fine = F.size(F.filter(F.slice(longs(bounds), F.col("_c") * step + 1, step), lambda b: b < k)) if bounds else F.lit(0)
    dealt = df.withColumn("_c", coarse).withColumn("_r", F.when(k.isNull(), -1).otherwise(F.col("_c") * step + fine)).drop("_c")
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(key, *(ties or [])))
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_r").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_r", "_i", "_before")


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with 0, 1, ... in an order of their own columns: dealt out by range, numbered inside a range, plus what lies before it.

    Ranges are as many as shuffle partitions; their sizes are all that is brought together. Only many rows of one and the
    same key would share a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges drawn for the sizes are those of the numbers, also after an executor is lost
    dealt = checkpoint(rows.repartitionByRange(n, *order).withColumn("_r", F.spark_partition_id()))
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_r").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(*order))
    numbered = dealt.withColumn("_i", inside).join(F.broadcast(before), F.col("_r") == F.col("_p"))
    return numbered.withColumn(name, (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_r", "_p", "_i", "_before")


def word_ids(counts: DataFrame, name: str = "word_id") -> DataFrame:
    """counts (word, word_count, ...) with ids from 0 by descending count, then word."""
    held = checkpoint(counts)  # ranges are drawn from a sample, which would count twice
    return _numbered(held, [F.desc("word_count"), F.col("word")], name).withColumn(name, F.col(name).cast("int"))


def string_numbers(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct strings of a column with 0, 1, ... in their order."""
    return _numbered(checkpoint(rows.select(key).distinct()), [F.col(key)], name).select(key, name)
