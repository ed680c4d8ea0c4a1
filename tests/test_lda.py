from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import arrays as A
from topicloom.operators import bow as B
from topicloom.operators import evaluate as E
from topicloom.operators import kernel
from topicloom.operators import lda as L
from topicloom.operators import similarity as S
from topicloom.operators import topics as P
from topicloom.sources import models

WORDS = ["apple", "banana", "cherry", "dog", "eagle", "fox"]
FRUIT, BEASTS = "apple banana cherry apple banana", "dog eagle fox dog eagle"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, FRUIT if i % 2 else BEASTS) for i in range(20)] + [(20, "unknown words"), (21, None)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def params():
    return L.LdaParams(num_topics=2, decay=1.0, total_docs=22, seed=3, perplexity=True)


@pytest.fixture(scope="module")
def model(docs, params):
    return L.OnlineLda(params).fit(docs, WORDS, 8)


def test_training_parts_the_topics(model):
    assert model.num_updates == 3 and len(model.perplexities) == 3 and all(np.isfinite(model.perplexities))
    top = [set(np.argsort(-row)[:3].tolist()) for row in model.lam]
    assert sorted(map(sorted, top)) == [[0, 1, 2], [3, 4, 5]]


def test_partitions_and_order_do_not_matter(docs, params, model):
    other = L.OnlineLda(params).fit(docs.orderBy(F.desc("doc_id")).repartition(7), WORDS, 8)
    np.testing.assert_allclose(other.lam, model.lam, rtol=1e-9)


def test_one_batch_equals_numpy(spark, docs, params):
    lda = L.OnlineLda(params)
    start = lda.start(WORDS)
    got = lda.partial_fit(start, lda.bags(docs, start))
    beta, ss, gammas, bags = kernel.exp_expectation(start.lam), np.zeros_like(start.lam), [], []
    for r in lda.bags(docs, start).collect():
        ids, n = np.array(r["word_ids"], int), np.array(r["counts"], float)
        g, s, _ = kernel.vb_document(n, beta[:, ids], kernel.start_gamma(3, r["doc_id"], 2), params.alpha, 100, 0.001)
        ss[:, ids] += s * beta[:, ids]
        gammas.append(g), bags.append((ids, n))
    np.testing.assert_allclose(got.lam, kernel.m_step(start.lam, ss, 22, eta=params.eta, tau=1.0, kappa=0.7, total_docs=22, updates=0), rtol=1e-9)
    bound = kernel.perplexity_bound(bags, np.array(gammas), start.lam, alpha=params.alpha, eta=params.eta, total_docs=22)
    assert got.perplexities[0] == pytest.approx(np.exp(-bound * 22 / (22 * 100)), rel=1e-9)


def test_bound_dataflow_equals_numpy(spark, docs, params):
    lda = L.OnlineLda(params)
    m = lda.start(WORDS)
    bags = lda.bags(docs, m)
    gamma = L.infer(bags, m.lam, params, statistics=False).select("doc_id", "gamma").cache()
    lam = m.lambda_long(spark)
    e = E.topic_expectation(lam)
    from topicloom.operators.relational_estep import beta_from

    row = E.bound(B.bag_of_words(docs, m.vocabulary(spark)), gamma, lam, beta_from(e).select("word_id", "e_beta"), alpha=params.alpha, eta=params.eta, k=2, v=6, total_docs=22).first()
    rows = bags.join(gamma, "doc_id").orderBy("doc_id").collect()
    want = kernel.perplexity_bound([(np.array(r["word_ids"], int), np.array(r["counts"], float)) for r in rows], np.array([r["gamma"] for r in rows]), m.lam, alpha=params.alpha, eta=params.eta, total_docs=22)
    assert row["score"] == pytest.approx(want, rel=1e-9) and row["batch_size"] == 22 and row["n_words"] == 100


@pytest.mark.parametrize("compat", ["local", "distributed"])
def test_join_strategy_equals_broadcast(spark, docs, compat):
    p = L.LdaParams(num_topics=2, seed=5, compat=compat)
    lda = L.OnlineLda(p)
    m = lda.start(WORDS)
    bow = B.bag_of_words(docs, m.vocabulary(spark))
    a = L.infer(lda.bags(docs, m), m.lam, p)
    b = L.infer_by_join(docs, bow, m.lambda_rows(spark), p)
    for left, right, key in ((a.filter("doc_id is not null"), b.filter("doc_id is not null"), "doc_id"),):
        x = {r[key]: r["gamma"] for r in left.collect()}
        y = {r[key]: r["gamma"] for r in right.collect()}
        assert x.keys() == y.keys()
        for k in x:
            np.testing.assert_allclose(x[k], y[k], rtol=1e-9)
    s, t = ({r["word_id"]: r["ss"] for r in L.sum_statistics(z.filter("word_id is not null"), 2).collect()} for z in (a, b))
    for w in s:
        np.testing.assert_allclose(s[w], t[w], rtol=1e-9)


def test_distributed_variant_normalises_by_document():
    # One document's gamma under both normalisers, from a start of ones.
    lam = np.array([[0.22, 0.7, 0.2, 0.3], [0.14, 0.29, 0.5, 0.2], [0.32, 0.43, 0.2, 0.45]])
    ids, n = np.array([0, 1]), np.array([5.0, 2.0])
    g, _, _ = kernel.vb_document(n, L._beta(lam)[:, ids], np.ones(3), 1 / 3, 100, 0.001)
    d, _, _ = kernel.vb_document(n, L._local_beta(lam[:, ids].T, np.zeros(2, int), 1).T, np.ones(3), 1 / 3, 100, 0.001)
    np.testing.assert_allclose(g, [0.4329, 0.3391, 7.2280], atol=6e-4)
    np.testing.assert_allclose(d, [0.3834, 0.3499, 7.2667], atol=6e-4)


def test_transform_and_double_expectation(docs, params, model):
    rows = L.OnlineLda(params).transform(docs, model).groupBy("doc_id").agg(F.sum("proportion").alias("s"), F.max("proportion").alias("m")).collect()
    assert len(rows) == 22 and all(r["s"] == pytest.approx(1) for r in rows)
    empty = [r["m"] for r in rows if r["doc_id"] >= 20]
    assert empty == pytest.approx([0.5, 0.5])
    assert L.OnlineLda(params).transform(docs, model, double=True).count() == 44


def test_similarity(spark, docs, params, model):
    v = S.topic_vectors(L.OnlineLda(params).transform(docs, model))
    pairs = spark.createDataFrame([(0, 2), (0, 1)], "a long, b long")
    d = {(r["a"], r["b"]): r["distance"] for r in S.document_distance(pairs, v).collect()}
    assert d[(0, 2)] < d[(0, 1)]
    c = {(r["a"], r["b"]): r["distance"] for r in S.document_distance(pairs, v, "cosine").collect()}
    assert c[(0, 2)] > c[(0, 1)]


def test_models_round_trip(spark, model, tmp_path):
    models.save_model(model, spark, str(tmp_path / "m"))
    got = models.load_model(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(got.lam, model.lam)
    assert got.vocab == model.vocab and got.num_updates == model.num_updates and got.params == model.params


def test_top_words_break_ties_by_id(spark):
    lam = spark.createDataFrame([(0, w, 1.0) for w in range(12)], "topic int, word_id int, value double")
    vocab = spark.createDataFrame([(w, f"w{w}") for w in range(12)], "word_id int, word string")
    assert [r["word_id"] for r in P.top_words(lam, vocab).collect()] == list(range(10))
    back = P.explode_rows(P.collect_rows(lam))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lam.collect()))


def test_coherence_leaves_out_unknown_words(spark):
    tops = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "zero"), (1, 1, "a"), (1, 2, "none")], "topic int, rank int, word string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("zero", [0.0, 0.0])], "word string, vector array<float>")
    got = {r["topic"]: (r["coherence"], r["n_pairs"]) for r in P.coherence(tops, vectors).collect()}
    assert got[0] == (pytest.approx(2**-0.5), 1) and got[1] == (None, 0)


def test_arrays(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0])], "a array<double>, b array<double>")
    got = row.select(A.array_sum(F.col("a"), F.col("b")), A.array_times_optional(F.col("a"), F.col("b")), A.array_times_optional(F.col("a"), F.lit(None).cast("array<double>")), A.euclidean_distance(F.col("a"), F.col("b"))).first()
    assert list(got) == [[5.0, 7.0], [4.0, 10.0], [1.0, 2.0, 3.0], pytest.approx(18**0.5)]


def test_mllib_cross_check(spark, docs, params):
    vocab = spark.createDataFrame(list(enumerate(WORDS)), "word_id int, word string")
    fitted = L.mllib_lda(docs, B.bag_of_words(docs, vocab), 6, params, max_iter=10)
    top = [set(r["termIndices"]) for r in fitted.describeTopics(3).collect()]
    assert len(top) == 2 and all(len(t) == 3 for t in top)


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "word_id int, word string")


def _table(model):
    return {(r["topic"], r["word_id"]): r["value"] for r in model.lambda_long().collect()}


def test_stream_minibatches_do_not_depend_on_the_cuts(spark, docs, vocab, tmp_path):
    """Files of 6 documents, minibatches of 8: the same lambda as fit_table's, also when a micro-batch is killed and replayed."""
    from topicloom.streaming import trainer

    p = L.LdaParams(num_topics=2, decay=1.0, total_docs=22, seed=3, perplexity=True)
    lda, folder = L.OnlineLda(p), str(tmp_path / "states")
    want = lda.fit_table(docs, vocab, 8)
    assert len(want.perplexities) == 3
    parts = [docs.filter((F.col("doc_id") >= i) & (F.col("doc_id") < i + 6)).select("doc_id", "text") for i in range(0, 22, 6)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    real, calls = trainer.Folders.commit, []

    def dies(self, name, tables, meta):
        calls.append(name)
        if name == "state-000000000003" and calls.count(name) == 1:
            raise RuntimeError("killed before its commit")
        real(self, name, tables, meta)

    trainer.Folders.commit = dies
    try:
        for _ in range(2):
            query = trainer.train_stream(stream, lda, vocab, folder, str(tmp_path / "checkpoint"), 8)
            try:
                query.awaitTermination()
            except Exception:
                assert calls[-1] == "state-000000000003"
    finally:
        trainer.Folders.commit = real
    assert calls.count("state-000000000003") == 2
    state = trainer.StreamState(spark, folder)
    assert state.model().num_updates == 2 and state.waiting().count() == 22 - 16
    assert len([n for n in state.folders.names() if n.startswith("state-")]) == trainer.KEPT
    got = trainer.finish(spark, lda, folder, 8)
    assert got.num_updates == 3 and trainer.finish(spark, lda, folder, 8).num_updates == 3
    np.testing.assert_allclose([v for _, v in sorted(_table(got).items())], [v for _, v in sorted(_table(want).items())], rtol=1e-9)
    np.testing.assert_allclose(got.perplexities, want.perplexities, rtol=1e-9)
    # a stream whose checkpoint is lost finds its commits and adds nothing
    trainer.train_stream(stream, lda, vocab, folder, str(tmp_path / "other"), 8).awaitTermination()
    assert state.model().num_updates == 3
    want.close()


def test_streaming_of_files(spark, vocab, tmp_path):
    from topicloom.streaming.trainer import StreamState, text_stream, train_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_text(FRUIT if i % 2 else BEASTS)
    lda = L.OnlineLda(L.LdaParams(num_topics=2, total_docs=5))
    train_stream(text_stream(spark, str(folder), 2), lda, vocab, str(tmp_path / "states"), str(tmp_path / "checkpoint"), 2).awaitTermination()
    state = StreamState(spark, str(tmp_path / "states"))
    assert state.model().num_updates == 2 and state.waiting().count() == 1


def test_commits_are_whole_or_absent(spark, vocab, tmp_path):
    from topicloom.sources.commit import STAGED, Folders

    folders = Folders(spark, str(tmp_path / "kept"))
    folders.commit("a", {"words": vocab}, {"n": 6})
    assert folders.names() == ["a"] and folders.manifest("a") == {"n": 6} and folders.table("a", "words").count() == 6
    folders.commit("a", {"words": vocab.limit(2)}, {"n": 2})
    assert folders.manifest("a") == {"n": 2} and folders.table("a", "words").count() == 2
    with pytest.raises(Exception):
        folders.commit("b", {"words": vocab.selectExpr("word", "raise_error('no')")}, {})
    assert folders.names() == ["a"]
    part = next((tmp_path / "kept" / "a" / "words").glob("part-*.parquet"))
    part.rename(tmp_path / "gone")  # a folder that lacks a file of its manifest is not committed
    assert folders.names() == [] and folders.manifest("a") is None
    (tmp_path / "kept" / f"{STAGED}x").mkdir()
    folders.sweep()
    assert not (tmp_path / "kept" / f"{STAGED}x").exists()


def test_table_models_at_rest(spark, docs, vocab, params, tmp_path, monkeypatch):
    table = L.OnlineLda(params).fit_table(docs, vocab, 8)
    models.save_model(table, spark, str(tmp_path / "m"))
    want = _table(table)
    table.close()
    got = models.load_table_model(spark, str(tmp_path / "m"))
    assert _table(got) == want and got.num_updates == 3 and got.params == params and len(got.perplexities) == 3
    assert got.top_words(2) == L.top_of(models.load_model(spark, str(tmp_path / "m")), 2)
    got.close()  # its tables stay
    assert isinstance(models.load(spark, str(tmp_path / "m")), L.LdaModel)
    monkeypatch.setattr(models, "BROADCAST_BYTES", 10)
    with pytest.raises(ValueError):
        models.load_model(spark, str(tmp_path / "m"))
    assert _table(models.load(spark, str(tmp_path / "m"))) == want
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"))


def test_perplexity_of_a_table_equals_the_drivers(docs, params):
    for compat in ("local", "distributed"):
        p = L.replace(params, compat=compat)
        a = L.OnlineLda(p).fit(docs, WORDS, 8)
        b = L.OnlineLda(L.replace(p, strategy="join")).fit(docs, WORDS, 8)
        np.testing.assert_allclose(b.perplexities, a.perplexities, rtol=1e-9)


def test_a_word_of_every_document_stays_out_of_the_shuffle(spark):
    """200 partitions, one word in all documents: no task gets over twice the median of the rows that are shuffled."""
    from topicloom.operators import skew

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("200", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(40000).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit(0), (F.col("id") * 7919 % 20000 + 1).cast("int"))).alias("word_id"))
        table = spark.range(20001).select(F.col("id").cast("int").alias("word_id"), (F.col("id") * 2).alias("value"))
        frequent = skew.frequent_keys(rows, "word_id")
        assert [r["word_id"] for r in frequent.collect()] == [0]
        got = skew.spread_join(rows, table, "word_id")
        assert got.count() == 80000 and got.filter("value <> 2 * word_id").isEmpty()
        sizes = sorted(r["count"] for r in skew.without_keys(rows, frequent, "word_id").join(table, "word_id").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 200 and sizes[-1] <= 2 * sizes[100]
        left = skew.spread_join(rows.withColumn("word_id", F.when(F.col("doc_id") < 5, None).otherwise(F.col("word_id"))), table.filter("word_id <> 0"), "word_id", "left")
        assert left.count() == 80000 and left.filter("word_id = 0 and value is not null").isEmpty() and left.filter("word_id is null").count() == 10
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_frequent_words_of_the_joined_e_step(spark, monkeypatch):
    """Words that many documents hold come by broadcast, the rest by join; the broadcast's bound may cut them, not the result."""
    rng = np.random.default_rng(2)
    texts = [" ".join(["apple"] * int(rng.integers(1, 4)) + list(rng.choice(WORDS[1:], 2))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lda = L.OnlineLda(L.LdaParams(num_topics=3, seed=1))
    m = lda.start(WORDS)
    want = {r["doc_id"]: r["gamma"] for r in L.infer(lda.bags(docs, m), m.lam, lda.params, statistics=False).collect()}
    bow = B.bag_of_words(docs, m.vocabulary(spark))
    for bytes_ in (1 << 20, 24, 0):
        monkeypatch.setattr(L, "BROADCAST_BYTES", bytes_)
        frequent, ids, rows = L._frequent_rows(bow, m.lambda_rows(spark), 3)
        assert 0 in ids and len(rows) == len(ids) == frequent.count()
        got = {r["doc_id"]: r["gamma"] for r in L.infer_by_join(docs, bow, m.lambda_rows(spark), lda.params, statistics=False).collect()}
        for i in want:
            np.testing.assert_allclose(got[i], want[i], rtol=1e-9)


def test_lambda_over_the_bound_is_joined(docs, params, model, monkeypatch):
    """Training and transform give the same beyond BROADCAST_BYTES."""
    want = {(r["doc_id"], r["topic"]): r["proportion"] for r in L.OnlineLda(params).transform(docs, model).collect()}
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    np.testing.assert_allclose(L.OnlineLda(params).fit(docs, WORDS, 8).lam, model.lam, rtol=1e-9)
    got = {(r["doc_id"], r["topic"]): r["proportion"] for r in L.OnlineLda(params).transform(docs, model).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("compat", ["local", "distributed"])
def test_training_with_lambda_as_a_table_equals_the_drivers(spark, docs, compat):
    """Both strategies over three minibatches, and a start drawn word by word."""
    start = np.random.default_rng(1).gamma(100, 0.01, (2, 6))
    p = L.LdaParams(num_topics=2, decay=1.0, total_docs=22, seed=3, compat=compat)
    a = L.OnlineLda(p).fit(docs, WORDS, 8, lam=start)
    b = L.OnlineLda(L.replace(p, strategy="join")).fit(docs, WORDS, 8, lam=start)
    assert a.num_updates == b.num_updates == 3
    np.testing.assert_allclose(b.lam, a.lam, rtol=1e-9)
    vocab = spark.createDataFrame(list(enumerate(WORDS)), "word_id int, word string")
    table = L.OnlineLda(p).fit_table(docs, vocab, 8)
    assert table.num_updates == 3 and table.lambda_long().count() == 12
    if compat == "local":
        tops = {frozenset(r["word"] for r in P.top_words(table.lambda_long(), vocab, 3).collect() if r["topic"] == k) for k in (0, 1)}
        assert tops == {frozenset(WORDS[:3]), frozenset(WORDS[3:])}
    shares = L.OnlineLda(p).transform(docs, table)
    assert shares.groupBy("doc_id").agg(F.sum("proportion").alias("s")).filter("abs(s - 1) < 1e-9").count() == 22
    table.close()


def test_many_documents_at_once_equal_one_by_one():
    rng = np.random.default_rng(4)
    lam, sizes = rng.gamma(100, 0.01, (4, 50)), [3, 0, 1, 20, 0, 7]
    doc = np.repeat(np.arange(6), sizes)
    ids, counts = rng.integers(0, 50, len(doc)), rng.integers(1, 9, len(doc)).astype(float)
    beta, gamma0 = kernel.exp_expectation(lam), rng.gamma(100, 0.01, (6, 4))
    for max_iter in (0, 1, 100):
        gamma, ss, _ = kernel.vb_documents(counts, beta[:, ids].T, doc, gamma0, 0.25, max_iter, 0.001)
        for d in range(6):
            g, s, _ = kernel.vb_document(counts[doc == d], beta[:, ids[doc == d]], gamma0[d], 0.25, max_iter, 0.001)
            np.testing.assert_allclose(gamma[d], g, rtol=1e-9)
            np.testing.assert_allclose(ss[doc == d].T, s, rtol=1e-9)


def test_progress_is_logged_and_can_be_switched_off(docs, caplog):
    import logging

    p = L.LdaParams(num_topics=2, total_docs=22, log_every=2)
    with caplog.at_level(logging.INFO, logger="topicloom"):
        L.OnlineLda(p).fit(docs, WORDS, 8)
    said = [r.getMessage() for r in caplog.records if r.name == "topicloom"]
    assert sum(m.startswith("update") for m in said) == 3 and sum(m.startswith("topic") for m in said) == 2
    caplog.clear()
    with caplog.at_level(logging.WARNING, logger="topicloom"):
        L.OnlineLda(p).fit(docs, WORDS, 8)
    assert not caplog.records
