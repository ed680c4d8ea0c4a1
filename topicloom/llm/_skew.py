"""Joins whose left side may have keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, partitions

#: A key is hot beyond this share of the rows that a task has on average; so at most partitions / SHARE keys are hot.
SHARE = 0.25


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """rows inner join table (one row per key at most) on key; no task gets all rows of a hot key.

    Hot keys are counted first (counts: key, n; or from rows). Their number is bounded by the
    number of partitions, so their rows of table are broadcast and their rows of `rows` stay where
    they are; all other keys meet in a shuffle. Null keys join nothing. rows is read up to three times.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    counts = counts.select(F.col(key).alias("_hot"), F.col("n").alias("_n")).filter("_hot is not null")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = cut(counts.filter(F.col("_n") > max(1, SHARE * total / partitions(rows.sparkSession))).select("_hot"))
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot)
    of_hot = F.broadcast(table.join(hot, table[key] == F.col("_hot"), "left_semi"))
    return rows.join(of_hot, key).unionByName(rows.join(hot, rows[key] == F.col("_hot"), "left_anti").join(table, key))


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows inner join table on key, where both may have many rows of a key; no task gets all rows of a hot key.

    A hot key's rows are dealt by the columns `by` to so many salts that each has a task's
    fair share, and its rows of table go to each of them; all salts together are at most twice
    partitions / SHARE. Null keys join nothing. rows is read twice.
    """
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter("_hot is not null")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    fair = max(1, SHARE * total / partitions(rows.sparkSession))
    hot = cut(counts.filter(F.col("_n") > fair).select("_hot", F.ceil(F.col("_n") / fair).cast("int").alias("_salts")))
    if hot.isEmpty():
        return rows.join(table, key)
    salts = F.coalesce("_salts", F.lit(1))
    with_salts = lambda side: side.join(F.broadcast(hot), side[key] == F.col("_hot"), "left")
    dealt = with_salts(rows).withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_hot", "_salts")
    copies = with_salts(table).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
