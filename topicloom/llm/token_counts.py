"""Token counts of a sentencepiece BPE vocabulary with the whole-token shortcut.

Offline, once per process, the model file is read for what the shortcut rests on:
- its own flags: a BPE model whose normaliser changes no character, keeps all spaces,
  writes each as the word mark and puts one before the text, and whose mark begins words;
- no piece has a word mark after another character, so no merge crosses the start of a
  word and a text's count is the sum over its words;
- pieces that, taken as a word, encode alone as one token. Such words count 1
  without any merging.
Other words are merged by the library, each distinct word once while it stays in a
bounded cache. A model whose flags or pieces are otherwise is counted text by text.

Defined results: a null text counts as empty (0 tokens, 0 bytes). Long texts are
counted in stretches that end at a space. Repeated rows give repeated rows, an empty
table gives none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from topicloom.llm._spark import small_batches, tidy

MARK = "▁"
STRETCH = 1 << 20
CACHE = 200_000
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffer message: numbers as they are, all else as bytes."""
    at, out = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            out[tag >> 3] = number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        out[tag >> 3] = message[at : at + size]
        at += size
    return out


def keeps_words(model: bytes) -> bool:
    """Whether the model's flags make a text's tokens those of its words: see the numbers of the public message format."""
    top = _fields(model)
    trainer, normaliser = _fields(top.get(2, b"")), _fields(top.get(3, b""))
    is_bpe, mark_ends_words = trainer.get(3, 1) == 2, trainer.get(24, 0)
    rules, prefix, fewer_spaces, marks = normaliser.get(2, b"") + normaliser.get(6, b""), normaliser.get(3, 1), normaliser.get(4, 1), normaliser.get(5, 1)
    return is_bpe and not mark_ends_words and not rules and bool(prefix) and not fewer_spaces and bool(marks)


class WordCounter:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        with open(path, "rb") as f:
            self.by_word = keeps_words(f.read()) and not any(MARK in p.lstrip(MARK) for _, p in pieces)
        words = [(i, p) for i, p in pieces if p[:1] == MARK and set(p) != {MARK}]
        whole = {p[1:]: 1 for (i, p), ids in zip(words, self.sp.encode([p[1:] for _, p in words]), strict=True) if ids == [i] and MARK not in p[1:]}
        whole[""] = 1  # a lone mark, which the library cannot be asked for by itself
        self.by_word &= any(p == MARK for _, p in pieces)
        self.whole = whole if self.by_word else {}
        self.marked = np.zeros(self.sp.get_piece_size(), np.int64)
        self.marked[[i for i, p in pieces if p[:1] == MARK]] = 1
        self.young: dict[str, int] = dict(self.whole)
        self.old: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        """words: without their first mark."""
        need = set(words)
        if len(self.young) + len(need) > CACHE + len(self.whole):
            self.old, self.young = self.young, dict(self.whole)
        rest = []
        for w in need:
            if w not in self.young:
                if (n := self.old.get(w)) is not None:
                    self.young[w] = n
                else:
                    rest.append(w)
        odd = [w for w in rest if MARK in w]
        for w, ids in zip(odd, self.sp.encode([w.replace(MARK, " ") for w in odd], num_threads=1), strict=True):
            self.young[w] = len(ids)
        if plain := [w for w in rest if MARK not in w]:
            # Merged together: a word's tokens start with the one token that has the mark.
            starts = np.cumsum(self.marked[np.array(self.sp.encode(" ".join(plain), num_threads=1))])
            self.young.update(zip(plain, np.bincount(starts - 1, minlength=len(plain)).tolist(), strict=True))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return len(self.sp.encode(text))
        total, at = 0, 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                cut = text.find(" ", at + STRETCH)
                while 0 < cut and text[cut - 1] in (" ", MARK):
                    cut = text.find(" ", cut + 1)
                end = cut if cut > 0 else end
            total += self._stretch(text[at:end])
            at = end + 1
            if at == len(text) and end < len(text):  # a last space of its own
                total += self._stretch("")
        return total

    def _stretch(self, part: str) -> int:
        """Tokens of a mark and part."""
        words = part.split(" ")
        if "" in words or MARK in part:
            words = [w[1:] for w in _RUNS.findall(MARK + part.replace(" ", MARK))]
        try:
            return sum(map(self.young.__getitem__, words))
        except KeyError:
            self._learn(words)
            return sum(map(self.young.__getitem__, words))


_loaded: dict[str, WordCounter] = {}


def load(path: str) -> WordCounter:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [counter.count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
