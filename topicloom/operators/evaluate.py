"""Perplexity as dataflow: four sums over documents and topics, joined by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_col, lgamma, lgamma_col, log_sum_exp_col


def expectation_rows(m: DataFrame, values: str, name: str) -> DataFrame:
    """m with a column name: the Dirichlet expectation of the array column values, row by row."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    psi_total = digamma_col(total)
    return m.withColumn("_psi", psi_total).withColumn(name, F.transform(values, lambda x: digamma_col(x) - F.col("_psi"))).drop("_psi")


def topic_expectation(lambda_long: DataFrame) -> DataFrame:
    """topic, word_id, value, e_log: each topic is normalised over its whole vocabulary; digamma of the sum once per topic."""
    sums = lambda_long.groupBy("topic").agg(F.sum("value").alias("total")).select("topic", digamma_col(F.col("total")).alias("psi"))
    return lambda_long.join(F.broadcast(sums), "topic").select("topic", "word_id", "value", (digamma_col(F.col("value")) - F.col("psi")).alias("e_log"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def document_terms(bow: DataFrame, gamma: DataFrame, beta_rows: DataFrame) -> DataFrame:
    """doc_id, likelihood: the sum over words of n times log sum over topics of exp(E log theta + E log beta).

    bow: doc_id, word_id, n; gamma: doc_id, gamma; beta_rows: word_id, e_beta (K values).
    """
    theta = expectation_rows(gamma, "gamma", "e_theta").select("doc_id", "e_theta")
    met = bow.join(theta, "doc_id").join(beta_rows, "word_id")
    term = F.col("n") * log_sum_exp_col(F.zip_with("e_theta", "e_beta", lambda a, b: a + b))
    return met.groupBy("doc_id").agg(F.sum(term).alias("likelihood"))


def gamma_terms(gamma: DataFrame, alpha: float, k: int) -> DataFrame:
    """doc_id, prior: what a document's gamma adds to the bound."""
    rows = expectation_rows(gamma, "gamma", "e_theta")
    cross = _sum(F.zip_with("gamma", "e_theta", lambda g, e: (alpha - g) * e))
    own = _sum(F.transform("gamma", lambda g: lgamma_col(g) - float(lgamma(alpha))))
    return rows.select("doc_id", (cross + own + float(lgamma(alpha * k)) - lgamma_col(_sum(F.col("gamma")))).alias("prior"))


def topic_terms(lambda_long: DataFrame, eta: float, v: int) -> DataFrame:
    """topic, prior: what a topic adds to the bound; v is the number of distinct words."""
    e = topic_expectation(lambda_long)
    terms = (F.lit(eta) - F.col("value")) * F.col("e_log") + lgamma_col(F.col("value")) - float(lgamma(eta))
    sums = e.groupBy("topic").agg(F.sum(terms).alias("s"), F.sum("value").alias("total"))
    return sums.select("topic", (F.col("s") + float(lgamma(eta * v)) - lgamma_col(F.col("total"))).alias("prior"))


def bound(bow: DataFrame, gamma: DataFrame, lambda_long: DataFrame, beta_rows: DataFrame, *, alpha: float, eta: float, k: int, v: int, total_docs: int) -> DataFrame:
    """One row: score, batch_size, n_words, per_word_perplexity. Every document of gamma counts, also those without words."""
    likelihood = document_terms(bow, gamma, beta_rows).agg(F.coalesce(F.sum("likelihood"), F.lit(0.0)).alias("likelihood"))
    prior = gamma_terms(gamma, alpha, k).agg(F.sum("prior").alias("doc_prior"), F.count("*").alias("batch_size"))
    topics = topic_terms(lambda_long, eta, v).agg(F.sum("prior").alias("topic_prior"))
    words = bow.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_words"))
    score = (F.col("likelihood") + F.col("doc_prior")) * F.lit(float(total_docs)) / F.col("batch_size") + F.col("topic_prior")
    one = likelihood.crossJoin(prior).crossJoin(topics).crossJoin(words)  # four tables of one row
    return one.select(score.alias("score"), "batch_size", "n_words").withColumn("per_word_perplexity", F.exp(-F.col("score") * F.col("batch_size") / (F.lit(float(total_docs)) * F.col("n_words"))))
