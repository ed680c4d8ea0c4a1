"""Steps that touch the words of their minibatch alone."""

from __future__ import annotations

import numpy as np
import pytest

from topicloom.operators import kernel
from topicloom.operators import lda as L


@pytest.mark.parametrize("compat", ["local", "distributed"])
@pytest.mark.parametrize("tau, least", [(1.0, 1e-60), (8.0, 1e-60), (8.0, 0.5)])
def test_scaled_steps_are_m_steps(monkeypatch, compat, tau, least):
    """A first rate of 1 (tau 1) and scales that are multiplied out on the way are among them."""
    monkeypatch.setattr(kernel.ScaledLambda, "LEAST", least)
    rng = np.random.default_rng(5)
    want = rng.random((3, 40)) + 0.5
    got = kernel.ScaledLambda(want)
    for i in range(30):
        words = np.sort(rng.choice(40, rng.integers(0, 9), replace=False))
        ss = np.zeros(want.shape)
        ss[:, words] = rng.random((3, len(words)))
        how = dict(eta=0.2, tau=tau, kappa=0.7, total_docs=90, updates=i, compat=compat)
        got.step(words, ss[:, words].T, 6, **how)
        want = kernel.m_step(want, ss, 6, **how)
        np.testing.assert_allclose(got.dense(), want, rtol=1e-12)
        np.testing.assert_allclose(got.totals, want.sum(1), rtol=1e-12)
        np.testing.assert_allclose(got.rows(words), want[:, words].T, rtol=1e-12)


def test_a_small_minibatch_needs_no_pass_over_all_words(spark, monkeypatch):
    """Packets beyond the broadcast too, since a step is sent its own words; the whole M-step is not called."""

    def refused(*a, **b):
        raise AssertionError("a pass over all words")

    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "c d") for i in range(9)], "doc_id long, text string")
    lda = L.OnlineLda(L.LdaParams(num_topics=2, total_docs=9))
    want = lda.fit(docs, ["a", "b", "c", "d"], 4)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(L, "infer_by_join", refused)
    monkeypatch.setattr(kernel, "m_step", refused)
    np.testing.assert_array_equal(lda.fit(docs, ["a", "b", "c", "d"], 4).lam, want.lam)
