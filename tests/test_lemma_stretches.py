"""The lemmatiser holds a stretch of a batch at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import lemma as M


def test_stretches_keep_order_and_size(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 10)
    texts = ["He left.", "", "x" * 30, "saw", "leaves", "", "a b"]
    got = list(M.stretches(texts))
    assert [t for part in got for t in part] == texts and max(sum(map(len, part)) for part in got if len(part) > 1) <= 10
    assert [r for part in got for r in M.lemmas_of(part)] == M.lemmas_of(texts)
    assert list(M.stretches([])) == []


def test_rows_of_many_stretches(spark):
    rows = spark.range(40).repartition(2).select("id", F.concat(F.repeat(F.lit("He leaves. "), 9000), F.col("id").cast("string")).alias("t"))
    got = {r["id"]: (r["n"], r["last"]) for r in rows.select("id", M.lemmatizer()(F.col("t")).alias("w")).select("id", F.size("w").alias("n"), F.element_at("w", -1).alias("last")).collect()}
    assert got == {i: (27001, str(i)) for i in range(40)}
