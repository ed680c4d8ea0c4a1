"""Joins by keys of which a few may have very many rows: count keys, broadcast the rows of frequent ones, shuffle the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.shared import checkpoint

#: A key is frequent beyond this share of the rows that a shuffle partition has on average, so at most partitions / SHARE keys are.
SHARE = 0.25


def frequent_keys(rows: DataFrame, key: str, share: float = SHARE, counts: DataFrame | None = None) -> DataFrame:
    """key, n_rows of the keys with over share * rows / partitions rows: partitions / share keys at most.

    counts (key, n_rows) saves the count where it is known. Null keys are left out: they join nothing.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    counts = counts.filter(F.col(key).isNotNull()).select(key, "n_rows")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(counts.filter(F.col("n_rows") > F.lit(max(1.0, share * total / partitions))))


def _keys(frequent: DataFrame, key: str) -> DataFrame:
    return F.broadcast(frequent.select(F.col(key).alias("_frequent")))


def without_keys(rows: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    return rows.join(_keys(frequent, key), rows[key] == F.col("_frequent"), "left_anti")


def with_keys(rows: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    return rows.join(_keys(frequent, key), rows[key] == F.col("_frequent"), "left_semi")


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", frequent: DataFrame | None = None) -> DataFrame:
    """rows join table on key ("inner" or "left"); table has one row per key at most.

    Rows of frequent keys stay where they are and meet a broadcast of those keys' rows of table, whose
    number is bounded (see frequent_keys); all others are shuffled. rows is read twice, and once more where
    the frequent keys are not given.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    frequent = frequent_keys(rows, key) if frequent is None else frequent
    if frequent.isEmpty():
        return rows.join(table, key, how)
    near = with_keys(rows, frequent, key).join(F.broadcast(with_keys(table, frequent, key)), key, how)
    return near.unionByName(without_keys(rows, frequent, key).join(table, key, how))
