"""One variational pass as joins and sums, without Python workers: for checks, and for a lambda that is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import dot
from topicloom.operators.bow import unpacked
from topicloom.operators.evaluate import expectation_rows
from topicloom.operators.kernel import FLOOR

#: Words whose K-vectors are broadcast (8 * K bytes each and as much again for the table).
BROADCAST_WORDS = 200_000


def theta_rows(gamma: DataFrame) -> DataFrame:
    """doc_id, theta: exp of the expectation of each gamma."""
    return expectation_rows(gamma, "gamma", "e").select("doc_id", F.transform("e", lambda x: F.exp(x)).alias("theta"))


def phi_norms(bow: DataFrame, gamma: DataFrame, beta_rows: DataFrame, n_words: int | None = None) -> DataFrame:
    """doc_id, word_id, n, phi, theta, beta: the normaliser of each word of each document.

    n_words, the rows of beta_rows where known: up to BROADCAST_WORDS they are broadcast, else joined by a shuffle.
    bow may be packed bags: then documents, not their words, are shuffled to meet gamma.
    """
    known = F.broadcast(beta_rows) if n_words is not None and n_words <= BROADCAST_WORDS else beta_rows
    theta = theta_rows(gamma)
    met = (unpacked(bow.join(theta, "doc_id"), "theta") if "word_ids" in bow.columns else bow.join(theta, "doc_id")).join(known, "word_id")
    return met.select("doc_id", "word_id", "n", (dot(F.col("theta"), F.col("beta")) + FLOOR).alias("phi"), "theta", "beta")


def next_gamma(phi: DataFrame, gamma: DataFrame, alpha: float, k: int) -> DataFrame:
    """doc_id, gamma after one pass; alpha where a document has no words."""
    sums = phi.groupBy("doc_id").agg(*[F.sum(F.col("n") / F.col("phi") * F.col("beta")[i]).alias(f"s{i}") for i in range(k)])
    each = [F.coalesce(F.col("theta")[i] * F.col(f"s{i}"), F.lit(0.0)) + F.lit(float(alpha)) for i in range(k)]
    return theta_rows(gamma).join(sums, "doc_id", "left").select("doc_id", F.array(*each).alias("gamma"))


def statistics(phi: DataFrame, beta_rows: DataFrame, k: int) -> DataFrame:
    """word_id, ss: sums of theta * n / phi, times beta."""
    sums = phi.groupBy("word_id").agg(*[F.sum(F.col("n") / F.col("phi") * F.col("theta")[i]).alias(f"s{i}") for i in range(k)])
    return sums.join(beta_rows, "word_id").select("word_id", F.zip_with(F.array(*[F.col(f"s{i}") for i in range(k)]), "beta", lambda s, b: s * b).alias("ss"))


def beta_from(lambda_long_with_e: DataFrame) -> DataFrame:
    """(word_id, beta, e_beta) from topic, word_id, e_log."""
    rows = lambda_long_with_e.groupBy("word_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("topic", "e_log"))), lambda x: x["e_log"]).alias("e_beta"))
    return rows.select("word_id", F.transform("e_beta", lambda x: F.exp(x)).alias("beta"), "e_beta")
