"""Command line: python -m topicloom vocabulary | train | proportions | similarity | coherence."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import DEFAULT_STOP_WORDS
from topicloom.operators import lda as L
from topicloom.operators import similarity as S
from topicloom.operators import topics as P
from topicloom.operators.shared import checkpoint
from topicloom.operators.vocabulary import build_vocabulary
from topicloom.sources import files, models

log = logging.getLogger("topicloom")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="topicloom", description=__doc__)
    top.add_argument("--quiet", action="store_true", help="log no progress")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        p.add_argument("corpus", help="a directory of text files")
        return p

    p = command("vocabulary", "write the words of a corpus that are frequent enough, one per line")
    p.add_argument("--out")
    p.add_argument("--min-count", type=int, default=5)
    p.add_argument("--min-docs", type=int, default=5)
    p.add_argument("--stop-words", help="a file with one word per line")
    p = command("train", "train a model and print its topics")
    p.add_argument("model", help="where to write it")
    p.add_argument("--vocabulary", help="a file with one word per line; without it, one is built from the corpus")
    for flag, kind, default in (("--batch-size", int, 100), ("--topics", int, 20), ("--total-docs", int, None), ("--decay", float, 1024.0), ("--learning-rate", float, 0.7), ("--max-iter", int, 100), ("--threshold", float, 0.001), ("--seed", int, 42)):
        p.add_argument(flag, type=kind, default=default)
    p.add_argument("--perplexity", action="store_true")
    p.add_argument("--strategy", choices=("broadcast", "join"), default="broadcast", help="lambda on the driver, or as a table that is joined")
    p.add_argument("--log-every", type=int, default=0, help="log the topics after so many minibatches")
    p = command("proportions", "topic proportions of each file")
    p.add_argument("model")
    p = command("similarity", "distances of pairs of files: those given, or all neighbours by path")
    p.add_argument("model")
    p.add_argument("--metric", choices=("euclidean", "cosine"), default="euclidean")
    p.add_argument("--pair", nargs=2, action="append", metavar="FILE", help="two files (names or path ends) to compare instead; may be given several times")
    p = command("coherence", "coherence of a model's topics under word vectors of the corpus")
    p.add_argument("model")
    p.add_argument("--vectors", help="where to write the word vectors")
    p.add_argument("--min-count", type=int, default=5)
    return top


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    """Does what the arguments say; returns the table that main prints."""
    a = parser().parse_args(argv)
    log.setLevel(logging.WARNING if a.quiet else logging.INFO)
    docs = files.read_corpus(spark, a.corpus)
    if a.command == "vocabulary":
        stop = files.read_word_list(spark, a.stop_words) if a.stop_words else DEFAULT_STOP_WORDS
        vocab = build_vocabulary(docs, a.min_count, a.min_docs, stop).orderBy("word_id")
        if a.out:
            vocab.select("word").coalesce(1).write.mode("overwrite").text(a.out)
        return vocab
    if a.command == "train":
        params = L.LdaParams(
            num_topics=a.topics, total_docs=a.total_docs, decay=a.decay, learning_rate=a.learning_rate, max_iter=a.max_iter, convergence_threshold=a.threshold, seed=a.seed,
            perplexity=a.perplexity, strategy=a.strategy, log_every=a.log_every,
        )
        lda = L.OnlineLda(params)
        if a.strategy == "join":  # neither lambda nor the vocabulary comes to the driver
            vocab = files.vocabulary_table(spark, a.vocabulary) if a.vocabulary else checkpoint(build_vocabulary(docs).select("word_id", "word"))
            trained = lda.fit_table(docs, vocab, a.batch_size)
        else:
            words = files.read_vocabulary(spark, a.vocabulary) if a.vocabulary else [r["word"] for r in build_vocabulary(docs).orderBy("word_id").collect()]
            trained = lda.fit(docs, words, a.batch_size)
        for i, figure in enumerate(trained.perplexities):
            log.info("minibatch %d: per-word perplexity %.4f", i, figure)
        models.save_model(trained, spark, a.model)
        if a.strategy == "join":
            trained.close()
        model = models.load_table_model(spark, a.model)
        return P.top_words(model.lambda_long(), model.vocab)
    if a.command == "coherence":
        model = models.load_table_model(spark, a.model)
        vectors = P.learn_word_vectors(docs, min_count=a.min_count)
        if a.vectors:
            models.save_word_vectors(vectors, a.vectors)
            vectors = models.load_word_vectors(spark, a.vectors)
        return P.coherence(P.top_words(model.lambda_long(), model.vocab, normalise=False), vectors)
    model = models.load(spark, a.model)
    shares = L.OnlineLda(model.params).transform(docs, model)
    if a.command == "proportions":
        return docs.select("doc_id", "path").join(shares, "doc_id").orderBy("doc_id", shares["proportion"].desc())
    pairs = docs.selectExpr("doc_id as a", "doc_id + 1 as b")
    if a.pair:
        named = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(a.pair)], "pair int, x string, y string")
        side = lambda c, name: docs.join(F.broadcast(named), F.col("path").endswith(F.concat(F.lit("/"), F.ltrim(F.col(c), F.lit("/"))))).select("pair", F.col("doc_id").alias(name))
        pairs = side("x", "a").join(side("y", "b"), "pair").select("a", "b")
    return S.document_distance(pairs, S.topic_vectors(shares), a.metric).orderBy("a", "b")


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("topicloom").getOrCreate()
    run(spark).show(1000, truncate=80)


if __name__ == "__main__":
    main()
