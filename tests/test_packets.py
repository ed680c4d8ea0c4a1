"""Small minibatches as packets: the same training, one job a step."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import lda as L
from topicloom.operators import packets as P

VOCAB = [f"{a}{b}" for a in "abcd" for b in "wxyz"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 5 % 41, None if i == 4 else " ".join(rng.choice(VOCAB, rng.integers(0, 9)))) for i in range(41)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("compat", ["local", "distributed"])
@pytest.mark.parametrize("given", [False, True])
def test_packets_train_as_whole_tables_do(spark, docs, monkeypatch, compat, given):
    monkeypatch.setattr(P, "PACKET_DOCS", 2)
    monkeypatch.setattr(P, "GROUP", 3)
    p = L.LdaParams(num_topics=3, total_docs=41, compat=compat, perplexity=True, decay=4.0)
    gamma = docs.filter("doc_id % 2 = 0").select("doc_id", F.array(F.lit(0.5), F.lit(1.0) + F.col("doc_id") % 3, F.lit(2.0)).alias("gamma")) if given else None
    got = L.OnlineLda(p).fit(docs, VOCAB, 6, gamma0=gamma)
    monkeypatch.setattr(L, "SMALL_BATCH", 0)
    want = L.OnlineLda(p).fit(docs, VOCAB, 6, gamma0=gamma)
    assert got.num_updates == want.num_updates == 7
    np.testing.assert_allclose(got.lam, want.lam, rtol=1e-9)
    np.testing.assert_allclose(got.perplexities, want.perplexities, rtol=1e-9)


def test_a_step_is_one_job(spark, docs):
    sc = spark.sparkContext
    jobs = {}
    for size in (2, 41):
        sc.setJobGroup(f"packets-{size}", "")
        L.OnlineLda(L.LdaParams(num_topics=3)).fit(docs, VOCAB, size)
        jobs[size] = len(sc.statusTracker().getJobIdsForGroup(f"packets-{size}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] - jobs[41] <= 20  # 21 minibatches and 1


def test_no_documents_leave_lambda(spark, docs):
    model = L.OnlineLda(L.LdaParams(num_topics=3)).fit(docs.limit(0), VOCAB, 6)
    assert model.num_updates == 0 and model.lam.shape == (3, 16)
