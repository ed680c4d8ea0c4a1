"""Vocabularies: counts of words and of their documents, filters, deterministic ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators.ranking import word_ids

#: Words up to this many are broadcast to the tokens (about 50 bytes each); a larger vocabulary is joined by a shuffle.
BROADCAST_WORDS = 500_000
#: So many times as many are sent to Python tasks as an index (about 150 bytes a word in a process).
INDEXED = 4


def tokens(docs: DataFrame, tokenizer: T.Tokenizer = T.cleaned_words, text: str = "text") -> DataFrame:
    """One row per token: doc_id, pos (from 0), word."""
    return docs.select("doc_id", F.posexplode(tokenizer(F.col(text))).alias("pos", "word"))


#: Distinct words whose counts a task holds before it passes them on.
HELD = 1 << 20


def ids_differ(docs: DataFrame) -> bool:
    """Whether each doc_id has one row, so that a row's counts are its document's. Only ids are read."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def to_count(docs: DataFrame, tokenizer: T.Tokenizer) -> DataFrame:
    """doc_id, words: what token_lists reads. The bag-of-words tokenizer's work is left to it."""
    return docs.select("doc_id", (F.col("text") if tokenizer is T.cleaned_words else tokenizer(F.col("text"))).alias("words"))


def token_lists(words: pa.Array) -> Iterator[list]:
    """The words of each row: as bytes of a raw text, or as they are in a list."""
    if pa.types.is_string(words.type) or pa.types.is_large_string(words.type):
        return (T.cleaned_bytes(t) for t in words.cast(pa.binary()).to_pylist())
    return (w or [] for w in words.to_pylist())


def _strings(words: Iterable) -> pa.Array:
    words = list(words)
    return pa.array(words, pa.binary()).cast(pa.string()) if words and isinstance(words[0], bytes) else pa.array(words, pa.string())


def _grouped_counts(docs: DataFrame, tokenizer: T.Tokenizer) -> DataFrame:
    return docs.select("doc_id", F.explode(tokenizer(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def document_counts(docs: DataFrame, tokenizer: T.Tokenizer = T.cleaned_words) -> DataFrame:
    """doc_id, word, n: each document's counts, by a shuffle only where a doc_id has several rows."""
    if not ids_differ(docs):
        return _grouped_counts(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, counts = [], [], []
            for i, own in enumerate(map(Counter, token_lists(batch.column("words")))):
                at += [i] * len(own)
                words += own
                counts += own.values()
                if len(words) > HELD or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), _strings(words), pa.array(counts, pa.int64())], ["doc_id", "word", "n"])
                    at, words, counts = [], [], []

    return to_count(docs, tokenizer).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string, n long")


def word_counts(docs: DataFrame, tokenizer: T.Tokenizer = T.cleaned_words) -> DataFrame:
    """word, word_count, doc_freq over the corpus. Tasks add up the words of their documents, so a word is shuffled about once per task."""
    if not ids_differ(docs):
        return _grouped_counts(docs, tokenizer).groupBy("word").agg(F.sum("n").alias("word_count"), F.count("*").alias("doc_freq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = Counter(), Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_strings(total), pa.array(total.values(), pa.int64()), pa.array([held[w] for w in total], pa.int64())], ["word", "n", "d"])

        for batch in batches:
            for words in token_lists(batch.column("words")):
                total.update(words)
                held.update(set(words))
                if len(total) > HELD:
                    yield passed()
                    total, held = Counter(), Counter()
        yield passed()

    counted = to_count(docs, tokenizer).select("words").mapInArrow(run, "word string, n long, d long")
    return counted.groupBy("word").agg(F.sum("n").alias("word_count"), F.sum("d").alias("doc_freq"))


def filter_words(counts: DataFrame, min_count: int, min_docs: int, stop_words: Iterable[str] = T.DEFAULT_STOP_WORDS, min_length: int = 3) -> DataFrame:
    """Words with a letter, long and frequent enough, and no stop words (compared in lower case)."""
    stop = sorted({w.lower() for w in stop_words})
    word = F.col("word")
    kept = counts.filter(T.has_letter(word) & (F.length(word) >= min_length) & (F.col("word_count") >= min_count) & (F.col("doc_freq") >= min_docs))
    return kept.filter(~F.lower(word).isin(stop)) if stop else kept


def build_vocabulary(docs: DataFrame, min_count: int = 5, min_docs: int = 5, stop_words: Iterable[str] = T.DEFAULT_STOP_WORDS, tokenizer: T.Tokenizer = T.cleaned_words, min_length: int = 3) -> DataFrame:
    """word_id (by descending count, then word), word, word_count, doc_freq."""
    kept = filter_words(word_counts(docs, tokenizer), min_count, min_docs, stop_words, min_length)
    return word_ids(kept).select("word_id", "word", "word_count", "doc_freq")


def vocabulary_from_list(words: DataFrame) -> DataFrame:
    """word_id, word from rows (pos, word): distinct words in the order of their first place."""
    first = words.groupBy("word").agg(F.min("pos").alias("pos"))
    from topicloom.operators.ranking import row_numbers

    return row_numbers(first, "pos", ties=[F.col("word")]).select((F.col("row_number") - 1).cast("int").alias("word_id"), "word")


def with_word_ids(rows: DataFrame, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """rows (word, ...) that are in the vocabulary, with word_id; size is the vocabulary's number of words where known."""
    size = vocab.count() if size is None else size
    known = vocab.select("word", "word_id")
    return rows.join(F.broadcast(known) if size <= BROADCAST_WORDS else known, "word")


def word_index(vocab: DataFrame, as_bytes: bool) -> dict | None:
    """Ids by word of a vocabulary that may be broadcast; None where a word has several ids."""
    rows = vocab.select("word", "word_id").filter("word is not null").toArrow()
    words = rows.column("word").cast(pa.binary() if as_bytes else pa.string()).to_pylist()
    index = dict(zip(words, rows.column("word_id").to_pylist(), strict=True))
    return index if len(index) == len(words) else None
