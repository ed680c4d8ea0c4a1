"""BPE encoding and decoding: speculate with greedy longest matches, verify adjacent pairs, merge the rest.

A word's tokens are right exactly when every token encodes to itself and every
adjacent pair of tokens is compatible, that is, no merge that the tokenizer would
have made earlier joins the end of one with the start of the next. Greedy longest
match proposes tokens; the pair test runs over all adjacent pairs of a batch at
once (numpy, over the distinct pairs); only words with a failing pair go through
the exact merge loop. Encodings of words are kept in a bounded cache.

Defined results: a null text counts as empty (no ids); added special tokens inside
a text get their own id, as the tokenizers library does by default; texts of any
length are encoded in stretches cut where the pre-tokenizer always cuts. Repeated rows
give repeated rows, an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from topicloom.llm._spark import small_batches, tidy

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRETCH = 1 << 20
CACHE = 150_000
_SAFE = regex.compile(r"\S \S")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        self.model = Tokenizer.from_file(path).model
        self.shown = {b: c for c, b in back.items()}
        raw = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [tuple(bytes(back[c] for c in s) for s in m) for m in merges]
        # Inside, a token's number is its order of making: single bytes first, then one for each merge.
        self.order: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            if a + b not in self.order:
                self.order[a + b] = len(left)
                left.append(self.order[a])
                right.append(self.order[b])
        n = len(left)
        self.left, self.right = np.array(left), np.array(right)
        keys = self.left[256:] * n + self.right[256:]
        at = np.argsort(keys)
        self.pair_keys, self.pair_made, self.n = keys[at], at + 256, n
        self.ids = np.array([raw[t] for t in self.order], np.uint32)
        whole = np.ones(n, bool)
        whole[256:] = self._compatible(self.left[256:], self.right[256:], np.arange(256, n))
        for t in range(256, n):
            whole[t] &= whole[left[t]] and whole[right[t]]
        tokens = list(self.order)
        self.greedy = {t: k for t, k in self.order.items() if whole[k]}
        self.longest = max(map(len, tokens))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([int(self.ids.max()), *self.special.values()]) + 1
        self.texts: list[bytes] = [b""] * size
        for t, i in zip(tokens, self.ids.tolist(), strict=True):
            self.texts[i] = t
        for s, i in self.special.items():
            self.texts[i] = s.encode()
        self.pieces = regex.compile(PATTERN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge before limit joins the end of a with the start of b, undoing their merges from the latest."""
        a, b, limit = a.astype(np.int64), b.astype(np.int64), limit.astype(np.int64)
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            key = a * self.n + b
            j = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[j] == key) & (self.pair_made[j] < limit)
            ok[at[bad]] = False
            one_a, one_b = a < 256, b < 256
            go = ~bad & ~(one_a & one_b)
            a, b, limit, at, one_a, one_b = a[go], b[go], limit[go], at[go], one_a[go], one_b[go]
            undo_a = ~one_a & (one_b | (a > b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The exact merges of one word, by the library's own model; ids of the vocabulary."""
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of distinct words: propose, verify, merge what failed."""
        get, longest = self.greedy.get, self.longest
        flat: list[int] = []
        sizes = []
        raw = [w.encode() for w in words]
        for w in raw:
            i, n, before = 0, len(w), len(flat)
            while i < n:
                j = min(n, i + longest)
                while (t := get(w[i:j])) is None:
                    j -= 1
                flat.append(t)
                i = j
            sizes.append(len(flat) - before)
        tokens, sizes = np.array(flat, np.int64), np.array(sizes)
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(words)), sizes)
        inner = word_of[1:] == word_of[:-1]
        pairs, where = np.unique((tokens[:-1] * self.n + tokens[1:])[inner], return_inverse=True)
        ok = self._compatible(pairs // self.n, pairs % self.n, np.full(len(pairs), self.n))
        failed = set(word_of[1:][inner][~ok[where]].tolist()) if len(pairs) else set()
        blob, out, start = self.ids[tokens].astype("<u4").tobytes(), {}, 0
        for k, end in enumerate(ends.tolist()):
            if k in failed:
                out[words[k]] = np.array(self.merge(raw[k]), "<u4").tobytes()
            else:
                out[words[k]] = blob[4 * start : 4 * end]
            start = end
        return out

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            m = _SAFE.search(text, at + STRETCH)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        parts = self.split_special.split(text) if self.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
                continue
            for stretch in self._stretches(part):
                words = self.pieces.findall(stretch)
                try:
                    out.append(b"".join(map(self.young.__getitem__, words)))
                except KeyError:
                    self._learn(words)
                    out.append(b"".join(map(self.young.__getitem__, words)))
        return b"".join(out)

    def _learn(self, words: list[str]) -> None:
        need = set(words)
        if len(self.young) + len(need) > CACHE:
            self.old, self.young = self.young, {}
        new = [w for w in need if w not in self.young]
        known = {w: b for w in new if (b := self.old.get(w)) is not None}
        self.young.update(known)
        rest = [w for w in new if w not in known]
        if rest:
            self.young.update(self._words(rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (array of token ids), and the two digests of encode_digests."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            coded = [bpe.encode(t) for t in _texts(batch)]
            sizes = [len(x) // 4 for x in coded]
            flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat), *_digests(bpe, coded)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def _digests(bpe: ByteBpe, coded: list[bytes]) -> list[pa.Array]:
    decoded = (bpe.decode(x).decode("utf-8", "replace").encode() for x in coded)
    return [pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids themselves stay in the task."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            coded = [bpe.encode(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), *_digests(bpe, coded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
