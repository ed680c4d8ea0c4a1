"""The pipeline stage by stage against brute force on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from tests_llm_helpers import brute_components, brute_dedup_texts


def corpus(tmp_path, spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    good = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage, question = good(40), good(30)
    docs = {i: good(60) + "\n" + good(40) for i in range(60)}
    for i in range(60, 90):
        docs[i] = " ".join(word().upper() + "!!" for _ in range(50))
    docs[90], docs[91] = docs[0], docs[1] + " more"
    docs[92], docs[93] = docs[2] + "\n" + passage, docs[3] + "\n" + passage
    docs[94] = docs[4][:100] + "\n" + question + "\n" + good(60)
    docs[95], docs[96] = None, ""
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, question)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages(tmp_path, spark):
    d, texts = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_removal", "benchmark_decontamination", "bpe_encoding"]
    kept = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe_encoding":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{name}")
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.read.parquet(f"{d}/{name}")
        kept.append((name, before, {r["doc_id"] for r in docs.collect()}, docs))
    _, _, ids, _ = kept[0]
    assert not ids & set(range(60, 90)) and ids >= set(range(60))
    _, before, ids, _ = kept[1]
    assert ids == {i for i, c in brute_components(before).items() if i == c}
    _, before, ids, df = kept[2]
    assert ids == set(before)
    want = brute_dedup_texts(before)
    for r in df.collect():
        assert r["text"] == want[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    _, before, ids, _ = kept[3]
    assert set(before) - ids == {94}
    _, before, ids, df = kept[4]
    assert ids == set(before)
    assert {r["doc_id"] for r in cp.run(spark, d).collect()} == ids


def test_empty_tables_and_rows_without_ids(tmp_path, spark):
    """No documents give no rows; rows without an id or text pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(1)
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (None, None, None, None, None), (None, " ".join(rng.choice(["plain", "words", "here", "and", "there"]) for _ in range(40)), "en", "s", 200), (4, "", "en", "s", 0), (4, "", "en", "s", 0)])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = cp.run(spark, d).collect()
        assert sorted(r["doc_id"] or 0 for r in got) == sorted(r[0] or 0 for r in rows)
