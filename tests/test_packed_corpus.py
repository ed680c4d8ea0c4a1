"""Packed corpora read as the files that they hold."""

from __future__ import annotations

import glob

from topicloom.plans import queries as Q
from topicloom.sources import files

TEXTS = {"b": "two\nlines\n", "a": "one", "c": "", "d": "\r\nx\r\n\r\ny", "e": "\n\n", "f": "é   \\ \" \t日"}


def test_packed_texts_are_read_as_files(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(text.encode())
    files.pack_texts(spark.createDataFrame(list(TEXTS.items()), "path string, text string").coalesce(2), f"{tmp_path}/packed")
    short = lambda rows: sorted((r[0].rsplit("/", 1)[-1], r[1]) for r in rows.collect())
    for read in (files.read_texts, files.read_lines):
        got = short(read(spark, f"{tmp_path}/packed", packed=True))
        assert [r for r in got if r != ("c", "")] == short(read(spark, f"{tmp_path}/files"))
    assert ("c", "") in short(files.read_texts(spark, f"{tmp_path}/packed", packed=True))  # Spark's reader leaves out empty files
    got = files.read_corpus(spark, f"{tmp_path}/packed", 2, packed=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["path"], r["batch_id"]) for r in got] == [(i, p, i // 2) for i, p in enumerate("abcdef")]


def test_queries_write_no_file_for_each_document(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}\nend") for i in range(-3, 60)], "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Q._as_files(spark, str(tmp_path))
    assert len(glob.glob(f"{folder}/**/part-*", recursive=True)) <= 4
    assert {r["doc_id"]: r["text"] for r in Q.source_texts(spark, str(tmp_path)).collect()} == {i: f"text {i} end" for i in range(-3, 60)}
