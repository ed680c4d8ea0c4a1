"""A small table with every awkward row: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[7] = "changed"
    far = base.split()
    for i in range(0, 120, 9):
        far[i] = "edit"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: " ".join(far), 5: None, 6: "", 7: " \t\n ", 8: "one two three", 9: "ONE two  three", 10: words(rng, 30) + "\n" + passage + " " + words(rng, 30),
        11: passage, 12: words(rng, 40), 13: "x" * 5000, 14: words(rng, 3000), 15: "ünïcödé ✓ 漢字 " * 40, 16: (base + " ") * 3, 17: "<|endoftext|> a<|endoftext|>", 18: words(rng, 12), 19: words(rng, 13), 20: words(rng, 5) + "\x0b" + words(rng, 5) + "　" + words(rng, 5), 50: base + " tail", 100: "lone",
    }
    out = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return [*out, out[0], (None, passage, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as the operators name theirs."""
    names = ["_id", "_th", "id", "th", "row", "spans", "hub", "rep", "key", "group", "shard", "slot", "w", "fp", "score", "_gone", "_k0", "_g0", "pos", "hash"]
    return docs.select("*", *[F.lit(f"keep {n}").alias(n) for n in names])
