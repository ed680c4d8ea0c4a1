from __future__ import annotations

import pytest

from topicloom.__main__ import run


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for i in range(12):
        (folder / f"{i:02}.txt").write_text("apple banana cherry apple\nbanana" if i % 2 else "wolf eagle tiger wolf eagle")
    return folder


def test_commands(spark, corpus, tmp_path):
    c, m = str(corpus), str(tmp_path / "m")
    vocab = [r["word"] for r in run(spark, ["vocabulary", c, "--out", str(tmp_path / "v")]).collect()]
    assert vocab == ["apple", "banana", "eagle", "wolf", "cherry", "tiger"]
    top = run(spark, ["train", c, m, "--topics", "2", "--batch-size", "6", "--decay", "1", "--vocabulary", str(tmp_path / "v"), "--perplexity"]).collect()
    assert {r["topic"] for r in top} == {0, 1}
    shares = run(spark, ["proportions", c, m]).collect()
    assert len(shares) == 24
    assert run(spark, ["similarity", c, m, "--metric", "cosine"]).count() == 11
    pairs = run(spark, ["--quiet", "similarity", c, m, "--pair", "00.txt", "02.txt", "--pair", "00.txt", "03.txt"]).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(0, 2), (0, 3)] and pairs[0]["distance"] < pairs[1]["distance"]
    assert run(spark, ["train", c, m, "--topics", "2", "--batch-size", "6", "--decay", "1", "--strategy", "join"]).count() == 12
    assert run(spark, ["coherence", c, m, "--min-count", "1", "--vectors", str(tmp_path / "wv")]).count() == 2


def test_a_missing_argument_is_told(spark):
    with pytest.raises(SystemExit):
        run(spark, ["train"])
