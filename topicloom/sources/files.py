"""Text sources: lines, whole files, directories as minibatches, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import join_lines
from topicloom.operators.ranking import row_numbers, string_numbers
from topicloom.operators.shared import checkpoint
from topicloom.operators.vocabulary import vocabulary_from_list


def pack_texts(rows: DataFrame, folder: str) -> None:
    """Writes (path, text) as a packed corpus: JSON lines, a file of the corpus to each, as many real files as rows has partitions.

    A real file for each text costs a listing, an opening and a rename for each, most of them on the driver.
    """
    rows.select("path", F.coalesce("text", F.lit("")).alias("text")).write.json(folder)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    """path, text; a line that can't be read is an error, whatever its length."""
    return spark.read.schema("path string, text string").option("mode", "FAILFAST").option("maxStringLen", 2**31 - 1).json(folder)


def read_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """path, line: one row per line (no order is implied), of files or of a packed corpus (see pack_texts)."""
    if packed:
        lines = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
        return _packed(spark, path).filter("text <> ''").select("path", F.explode(lines).alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8", packed: bool = False) -> DataFrame:
    """path, text: one row per file, lines joined by a space. Hidden files are skipped.

    UTF-8 goes through the text reader; other encodings are decoded from binary files. packed: see pack_texts; there an empty text has a row, too.
    """
    if packed:
        rows = _packed(spark, path)
    elif encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        rows = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("text"))
    return rows.select("path", join_lines(F.col("text")).alias("text"))


def read_corpus(spark: SparkSession, path: str, batch_size: int | None = None, encoding: str = "UTF-8", packed: bool = False) -> DataFrame:
    """doc_id (from 0, by path), path, text, and batch_id where batch_size is given. Files are read on the executors."""
    texts = read_texts(spark, path, encoding, packed)
    ids = string_numbers(texts, "path", "doc_id")
    docs = texts.join(ids, "path").select("doc_id", "path", "text")
    if batch_size is None:
        return docs
    return docs.withColumn("batch_id", F.floor(F.col("doc_id") / batch_size).cast("int"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text from a Parquet table."""
    return spark.read.parquet(path).select("doc_id", "text")


def with_doc_ids(docs: DataFrame, key: str) -> DataFrame:
    """docs with doc_id from 0 in the order of a numeric key."""
    return row_numbers(docs, key, "_place").withColumn("doc_id", F.col("_place") - 1).drop("_place")


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """word: a list with one word per line, either kind of line break, blank lines dropped, in lower case, each once."""
    words = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("w"))
    return words.select(F.lower(F.trim("w")).alias("word")).filter("word <> ''").distinct()


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """A stop-word list on the driver, for one that is known to be short (see word_table)."""
    return sorted(r["word"] for r in word_table(spark, path).collect())


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word of a vocabulary file with one word per line: ids are the places of first occurrence, without the driver."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "w"))
    return checkpoint(vocabulary_from_list(lines.select("pos", F.trim("w").alias("word")).filter("word <> ''")).select("word_id", "word"))


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary file: one word per line; ids are the places of first occurrence."""
    rows = spark.read.text(path, wholetext=True).select("value").collect()
    return list(dict.fromkeys(w.strip() for r in rows for w in r["value"].splitlines() if w.strip()))
