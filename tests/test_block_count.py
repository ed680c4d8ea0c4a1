"""Blocks of word vectors: as many as cores train side by side, not as many as the vocabulary has stretches."""

from __future__ import annotations

import numpy as np

from topicloom.functions import text as T
from topicloom.operators import word_vectors as W
from topicloom.operators.shared import Scratch


def test_rounds_do_not_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_WORDS", 1)
    docs = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(4)], "doc_id long, text string")
    names = []
    monkeypatch.setattr(Scratch, "save", lambda self, rows, name, *a, f=Scratch.save: names.append(name) or f(self, rows, name, *a))
    assert W.learn(docs, W.SkipGram(size=4, epochs=1, min_count=2), T.cleaned_words).count() == 8
    cores = spark.sparkContext.defaultParallelism
    assert len([x for x in names if x.startswith("state-")]) == cores < 8


def test_block_count():
    p = W.SkipGram(size=32)
    assert W.block_count(25_000, 10**6, p, 12) == 3
    assert W.block_count(800_000, 10**8, p, 12) == W.block_count(400_000, 10**8, p, 12) == 12
    assert W.block_count(5_000_000, 10**8, p, 12) * W.BLOCK_BYTES >= 5_000_000 * 32 * p.size
    assert W.block_count(800_000, 10**11, p, 12) ** 2 * W.BUCKET_PAIRS >= 10**12 or W.block_count(800_000, 10**11, p, 12) == 80


def test_short_and_long_stretches_add_up_alike():
    rng = np.random.default_rng(2)
    at = np.sort(np.concatenate([np.arange(40), rng.integers(0, 12, 60), np.full(30, 5)]))
    rows, share, of = rng.random((9, 3)), rng.random(len(at)), rng.integers(0, 9, len(at))
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    np.testing.assert_allclose(W._sums(rows, share, of, starts), np.add.reduceat(rows[of] * share[:, None], starts), rtol=1e-14)
