"""Top words of topics, word vectors, coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.arrays import cosine_similarity
from topicloom.functions import text as T


def explode_rows(lambda_rows: DataFrame) -> DataFrame:
    """topic, word_id, value from (word_id, weights)."""
    return lambda_rows.select(F.posexplode("weights").alias("topic", "value"), "word_id").select("topic", "word_id", "value")


def collect_rows(lambda_long: DataFrame) -> DataFrame:
    """(word_id, weights) from topic, word_id, value."""
    return lambda_long.groupBy("word_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("topic", "value"))), lambda x: x["value"]).alias("weights"))


def topic_shares(lambda_long: DataFrame) -> DataFrame:
    """topic, word_id, probability: each value's share of its topic (a pre-aggregated sum, joined back)."""
    sums = lambda_long.groupBy("topic").agg(F.sum("value").alias("_total"))
    return lambda_long.join(F.broadcast(sums), "topic").select("topic", "word_id", (F.col("value") / F.col("_total")).alias("probability"))


def top_words(lambda_long: DataFrame, vocab: DataFrame, n: int = 10, normalise: bool = True) -> DataFrame:
    """topic, rank (from 1), word_id, word, probability (or value): ties go to the lower word_id.

    Each task keeps n words of a topic before the shuffle.
    """
    name = "probability" if normalise else "value"
    scored = topic_shares(lambda_long) if normalise else lambda_long
    order = Window.partitionBy("topic").orderBy(F.desc(name), "word_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return best.join(vocab.select("word_id", "word"), "word_id").select("topic", "rank", "word_id", "word", name).orderBy("topic", "rank")


def learn_word_vectors(docs: DataFrame, size: int = 100, min_count: int = 5, seed: int = 42, partitions: int | None = None, iterations: int | None = None, engine: str = "texts") -> DataFrame:
    """word, vector over Treebank tokens of the raw texts.

    engine "texts" (see text_vectors) and "mllib" (Spark's Word2Vec) hold vocabulary x size in every task, "mllib" on the driver
    too: partitions train side by side, by default as many as the session's cores; their vectors are averaged after each
    iteration, and an iteration sees each text once, so there are two of them where there are several partitions. "texts" learns by
    negative sampling, in dense steps; "mllib" by hierarchical softmax, pair by pair, in several times the time. "blocks" keeps the
    vectors in a table, whatever the vocabulary's size (see word_vectors).
    """
    if engine == "blocks":
        from topicloom.operators.word_vectors import SkipGram, learn

        return learn(docs, SkipGram(size=size, min_count=min_count, seed=seed, epochs=iterations or SkipGram.epochs))
    if engine not in ("texts", "mllib"):
        raise ValueError("engine is 'texts', 'mllib' or 'blocks'")
    partitions = partitions or min(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    iterations = iterations or (1 if partitions == 1 else 2)
    if engine == "texts":
        from topicloom.operators import text_vectors
        from topicloom.operators.word_vectors import SkipGram

        return text_vectors.learn(docs, SkipGram(size=size, min_count=min_count, seed=seed, epochs=iterations, rate=0.025, sample=0.0), partitions)
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = docs.select(T.treebank_words(F.col("text")).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, maxIter=iterations, inputCol="words", outputCol="out").fit(rows)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def coherence(tops: DataFrame, vectors: DataFrame) -> DataFrame:
    """topic, words, coherence (mean cosine of all pairs of top words), n_pairs; best first.

    tops: topic, rank, word; vectors: word, vector. Words without a vector and pairs with a zero vector are left out; a
    topic without pairs has a null coherence.
    """
    known = tops.join(vectors, "word").select("topic", "rank", "vector")
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.topic").alias("topic"), cosine_similarity(F.col("a.vector"), F.col("b.vector")).alias("cos"))
    means = pairs.groupBy("topic").agg(F.avg("cos").alias("coherence"), F.count("cos").cast("int").alias("n_pairs"))
    words = tops.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    return words.join(means, "topic", "left").select("topic", "words", "coherence", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs")).orderBy(F.desc("coherence"), "topic")
