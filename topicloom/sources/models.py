"""Models and word vectors at rest: Parquet tables that are committed together with their metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.lda import BROADCAST_BYTES, LdaModel, LdaParams, TableModel, rows_to_dense
from topicloom.sources.commit import Folders


def _split(path: str) -> tuple[str, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return root or "/", name


def model_tables(model: LdaModel | TableModel, spark: SparkSession) -> dict[str, DataFrame]:
    """lambda (word_id, weights) and vocabulary (word_id, word)."""
    if isinstance(model, TableModel):
        return {"lambda": model.rows.select("word_id", "weights"), "vocabulary": model.vocab.select("word_id", "word")}
    return {"lambda": model.lambda_rows(spark), "vocabulary": model.vocabulary(spark)}


def save_model(model: LdaModel | TableModel, spark: SparkSession, path: str) -> None:
    """lambda, vocabulary and metadata under path, all or nothing; a table model's tables are written by the tasks."""
    root, name = _split(path)
    Folders(spark, root).commit(name, model_tables(model, spark), model.metadata())


def _metadata(spark: SparkSession, path: str) -> tuple[Folders, str, dict]:
    root, name = _split(path)
    folders = Folders(spark, root)
    meta = folders.manifest(name)
    if meta is None:
        raise FileNotFoundError(f"no whole model at {path}")
    return folders, name, meta


def load_table_model(spark: SparkSession, path: str) -> TableModel:
    """The model with its tables left where they are; close() leaves them there too."""
    folders, name, meta = _metadata(spark, path)
    return TableModel(folders.table(name, "lambda"), folders.table(name, "vocabulary"), LdaParams(**meta["params"]), meta["num_updates"], None, meta.get("perplexities", []))


def load_model(spark: SparkSession, path: str) -> LdaModel:
    """The model on the driver. Its size is checked first: beyond BROADCAST_BYTES see load_table_model."""
    folders, name, meta = _metadata(spark, path)
    vocab, params = folders.table(name, "vocabulary"), LdaParams(**meta["params"])
    n, size = vocab.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if 8 * params.num_topics * n + (size or 0) > BROADCAST_BYTES:
        raise ValueError(f"a model of {n} words does not fit on the driver; use load_table_model")
    words = [r["word"] for r in vocab.orderBy("word_id").collect()]
    lam = rows_to_dense(folders.table(name, "lambda"), len(words)) if words else np.zeros((params.num_topics, 0))
    return LdaModel(lam, words, params, meta["num_updates"], meta.get("perplexities", []))


def load(spark: SparkSession, path: str) -> LdaModel | TableModel:
    """The model on the driver where it fits, else its tables."""
    try:
        return load_model(spark, path)
    except ValueError:
        return load_table_model(spark, path)


def save_word_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("word", "vector").write.mode("overwrite").parquet(path)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
