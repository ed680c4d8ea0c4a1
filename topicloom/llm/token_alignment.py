"""Alignment of two tokenizers: which tokens of one overlap which tokens of the other, and how often in the corpus.

1. Both tokenizers encode a text (words' ids stay in bounded caches). Where the byte offsets
   of both cut it, each elementary piece is one overlap of an A token and a B token, so
   links are read off the merged offsets, and places where both end are the groups'. Many
   texts are aligned at once; a long text in stretches, cut where both tokenizers
   always cut (as a whole if B's own flags don't promise it).
2. A task sums its distinct (A id, B id) pairs, once a document, before they are shuffled.
   Pairs are partitioned by stripe: A id modulo STRIPES, so neighbouring ids, which are often
   equally frequent, lie in different stripes. A stripe adds its pairs with np.add.at into dense
   blocks of BLOCK A ids by all B ids; the maximum of a row is the A id's best count.
   If many tasks report, each stripe's reports are first summed in salted parts.
3. Documents' links lie packed by (batch of documents, stripe) and meet the stripe's counts in
   tasks of the same stripe; a stripe with many bytes of links is dealt to several tasks, each
   with the stripe's counts (bounded by the two vocabularies). Sums return per batch.

Defined results: a null or empty text, and one whose joined token bytes are not those of a space
and the text in both tokenizers, have no tokens: zeros and the group digest ''. Special tokens'
strings are plain text. Repeated rows count as documents of their own and give repeated
rows; a null doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._spark import Scratch, cut, partitions, small_batches, tidy
from topicloom.llm._words import split_points
from topicloom.llm.bpe import ByteBpe
from topicloom.llm.token_counts import MARK, keeps_words

#: Shares of the A ids that are counted and scored apart; a dense block has BLOCK rows of int64 (16 MB for 32,000 B ids).
STRIPES, BLOCK = 64, 64
#: Words whose B ids a task keeps, twice. Characters of text that are aligned at once, at a place where both tokenizers cut.
CACHE, STRETCH = 150_000, 1 << 19
#: Text of one batch of documents, and documents of it; pairs that a task gathers before it reports them.
BATCH_BYTES, BATCH_DOCS, PAIRS = 2 << 20, 1 << 14, 1 << 20
#: Bytes of links, and rows of reports, of one task of a stripe.
LINK_BYTES, REPORTS = 32 << 20, 256
_CUT = regex.compile(r"\S \S")
_RUNS = regex.compile(r" *[^ ]+| +")


class Aligned(NamedTuple):
    """Of texts in order: tokens and groups of each, links (A id * size of B + B id), and groups as bytes that end with ;."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[bytes]


class _Words:
    """Ids of words as bytes, kept in two generations of about CACHE words; make: the ids of words that are new."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes | None]]):
        self.make, self.young, self.old = make, {}, {}

    def ids(self, words: list[str]) -> bytes | None:
        """None if one of the words has None."""
        if need := set(words).difference(self.young):
            if len(self.young) + len(need) > CACHE:
                self.old, self.young = self.young, {}
                need = set(words)
            known = [w for w in need if w in self.old]
            self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
            new = list(need.difference(known))
            self.young.update(zip(new, self.make(new), strict=True))
        found = list(map(self.young.__getitem__, words))
        return None if None in found else b"".join(found)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Aligner:
    """Byte-level BPE A and sentencepiece model B."""

    def __init__(self, path_a: str, path_b: str):
        self.a = ByteBpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        with open(path_b, "rb") as f:
            words = keeps_words(f.read())
        self.by_word = words and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.marked = np.array([p[:1] == MARK for p in pieces])
        self.size_a, self.size_b = len(self.a.texts), size
        self.length_a, self.length_b = np.array([len(t) for t in self.a.texts]), np.array([len(t) for t in self.bytes_b])
        self.shown = np.array([f"{i}{c}" for i in range(self.size_a) for c in ",|"] + [f"{i}{c}" for i in range(size) for c in ",;"], "S")
        self.words_a = _Words(lambda new: (_bytes(self.a.merge(w.encode())) for w in new))
        self.words_b = _Words(self._new_b)

    def stretches(self, text: str) -> list[str]:
        """text in pieces of at least STRETCH characters, cut before a space where both tokenizers cut."""
        out, at = [], 0
        while self.by_word and len(text) - at > STRETCH and (m := _CUT.search(text, at + STRETCH)):
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
        return [*out, text[at:]]

    def _spelled(self, ids: list[int], text: str) -> bytes | None:
        return _bytes(ids) if b"".join(map(self.bytes_b.__getitem__, ids)) == text.encode() else None

    def _new_b(self, words: list[str]) -> Iterable[bytes | None]:
        """B ids of words without their first space; None for those that B doesn't spell."""
        plain = " ".join(words)
        if "" in words or MARK in plain or plain.count(" ") >= len(words):
            odd = [w for w in words if not w or " " in w or MARK in w]
            rest = [w for w in words if w and " " not in w and MARK not in w]
            made = dict(zip(rest, self._new_b(rest), strict=True)) if rest else {}
            return [made[w] if w in made else self._spelled(self._one(w), f" {w}") for w in words] if odd else list(made.values())
        # merged together: a word's tokens start with the one token that has the mark
        found = self.b.encode(plain, num_threads=1)
        ids = np.array(found, "<u4")
        starts = np.flatnonzero(self.marked[ids]).tolist()
        raw, ends = ids.tobytes(), [*starts[1:], len(found)]
        if len(starts) == len(words) and b"".join(map(self.bytes_b.__getitem__, found)) == f" {plain}".encode():
            return [raw[4 * i : 4 * j] for i, j in zip(starts, ends, strict=True)]
        return [self._spelled(self._one(w), f" {w}") for w in words]

    def _one(self, word: str) -> list[int]:
        """B ids of a space and word, by themselves."""
        if word:
            return self.b.encode(word, num_threads=1)
        return [self.b.piece_to_id(MARK)]  # a lone mark, which the library cannot be asked for by itself

    def encode_a(self, text: str) -> bytes:
        return self.words_a.ids(self.a.pieces.findall(text))

    def encode_b(self, text: str) -> bytes | None:
        """B ids of text, which starts with a space; None where they don't spell it."""
        if not self.by_word:
            return self._spelled(self.b.encode(text[1:], num_threads=1), text)
        words = text[1:].split(" ")
        if "" in words:
            words = [w[1:] for w in _RUNS.findall(text)]
        return self.words_b.ids(words)

    def align(self, texts: list[str]) -> tuple[list[int], Aligned]:
        """The numbers of the texts (each starts with a space) that both spell, and their alignment."""
        coded = [(i, self.encode_a(t), b, len(t.encode())) for i, t in enumerate(texts) if (b := self.encode_b(t)) is not None]
        n_a, n_b = np.array([len(a) // 4 for _, a, _, _ in coded], np.int64), np.array([len(b) // 4 for _, _, b, _ in coded], np.int64)
        a, b = (np.frombuffer(b"".join(c[k] for c in coded), "<u4").astype(np.int64) for k in (1, 2))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        stops = np.cumsum([n for _, _, _, n in coded], dtype=np.int64)
        if len(coded) and not (np.array_equal(ends_a[np.cumsum(n_a) - 1], stops) and np.array_equal(ends_b[np.cumsum(n_b) - 1], stops)):
            raise ValueError("tokens do not spell their text")
        at_a, at_b = (np.zeros(int(stops[-1]) + 1 if len(stops) else 1, bool) for _ in range(2))
        at_a[ends_a], at_b[ends_b] = True, True
        both = at_a & at_b
        upto_a, upto_b, upto_group = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, both))
        # a token covers the bytes up to an end if it is the first that does not stop before it
        ends = np.flatnonzero(at_a | at_b)
        links = a[upto_a[ends] - at_a[ends]] * self.size_b + b[upto_b[ends] - at_b[ends]]
        last = np.flatnonzero(both)
        group_a, group_b = upto_group[ends_a] - both[ends_a], upto_group[ends_b] - both[ends_b]
        # a group's A tokens come after the B tokens of earlier groups, its B tokens after its own A tokens
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.concatenate(([0], upto_b[last]))[group_a]] = 2 * a + both[ends_a]
        shown[np.arange(len(b)) + upto_a[last][group_b]] = 2 * (self.size_a + b) + both[ends_b]
        edges = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        groups = [self.shown[shown[x:y]].tobytes().translate(None, b"\0") for x, y in zip(edges, edges[1:], strict=False)]
        per = lambda where: np.diff(np.searchsorted(where, stops, "right"), prepend=0)
        return [c[0] for c in coded], Aligned(n_a, n_b, per(last), per(ends), links, groups)


_loaded: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded.clear()
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<q", x.nbytes) + x.tobytes() for x in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = struct.unpack_from("<q", blob, at)[0]
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the ends of runs."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values))


_TOKENS = "batch long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_STORED = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("links", pa.binary()), ("pairs", pa.binary())])


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STORED], schema=_STORED)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about BATCH_BYTES characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= BATCH_BYTES or len(ids) >= BATCH_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their times."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, times)
    return keys, total


def align_texts(aligner: Aligner, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text n_a, n_b, n_groups, n_links (columns) and the digest of its groups; place, pair and number of its distinct links."""
    units = [(i, s) for i, t in enumerate(texts) if t for s in aligner.stretches(f" {t}")]
    counts, digests, lost = np.zeros((len(texts), 4), np.int64), {}, set()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in split_points(np.array([len(s) for _, s in units]), BATCH_BYTES):
        known, told = aligner.align([s for _, s in units[x:y]])
        place = np.array([units[x + k][0] for k in known], np.int64)
        lost |= {i for i, _ in units[x:y]} - set(place.tolist()) if len(known) == y - x else {units[x + k][0] for k in set(range(y - x)) - set(known)}
        np.add.at(counts, place, np.stack([told.n_a, told.n_b, told.n_groups, told.n_links], axis=1))
        for i, part in zip(place.tolist(), told.groups, strict=True):
            if i in digests:
                digests[i].update(b";" + part[:-1])
            else:
                digests[i] = hashlib.sha256(part[:-1])
        found.append(np.unique(np.repeat(place, told.n_links) << 40 | told.links, return_counts=True))
    keys, times = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
    if len(found) > 1:  # a long text's stretches
        keys, times = _merged(keys, times)
    place = keys >> 40
    if lost:
        keep = ~np.isin(place, list(lost))
        place, keys, times = place[keep], keys[keep], times[keep]
        counts[list(lost)] = 0
    return counts, [digests[i].hexdigest() if i in digests and i not in lost else "" for i in range(len(texts))], place, keys & (1 << 40) - 1, times


def _encode(path_a: str, path_b: str, stripes: int):
    """Per document its counts; per batch and stripe its packed links; per task and stripe its pairs with the documents that hold them."""

    def by_stripe(keys: np.ndarray, size_b: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        stripe = keys // size_b % stripes
        order = np.argsort(stripe, kind="stable")
        starts, ends = _runs(stripe[order])
        return order, [(int(stripe[order[a]]), slice(a, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        task, seen, n_seen = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def report() -> pa.RecordBatch:
            order, parts = by_stripe(seen, aligner.size_b)
            keys, n = seen[order], n_seen[order]
            return _rows(batch=[task] * len(parts), stripe=[s for s, _ in parts], pairs=[_pack(keys[p], n[p]) for _, p in parts])

        for number, (ids, texts) in enumerate(_documents(batches)):
            batch = task << 32 | number
            counts, digests, place, keys, times = align_texts(aligner, texts)
            n_a, n_b, n_groups, n_links = counts.T
            yield _rows(batch=[batch] * len(ids), place=list(range(len(ids))), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digests)
            own, n = np.unique(keys, return_counts=True)
            order, parts = by_stripe(keys, aligner.size_b)
            place, keys, times = place[order], keys[order], times[order]
            local, column = keys // aligner.size_b // stripes, keys % aligner.size_b
            yield _rows(batch=[batch] * len(parts), stripe=[s for s, _ in parts], links=[_pack(*(_narrow(x[p]) for x in (local, column, place, times))) for _, p in parts])
            seen, n_seen = _merged(np.concatenate([seen, own]), np.concatenate([n_seen, n]))
            if len(seen) >= PAIRS:
                yield report()
                seen, n_seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(seen):
            yield report()

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<i8") if not len(x) or x.max() <= np.iinfo(k).max))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and sizes."""
    return b"".join(struct.pack("<3sq", x.dtype.str.replace("|", "<").encode(), len(x)) + x.tobytes() for x in arrays)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = struct.unpack_from("<3sq", blob, at)
        out.append(np.frombuffer(blob, kind.decode(), n, at + 11))
        at += 11 + out[-1].nbytes
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the ends of runs."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of consecutive equal keys, one at a time."""
    rows = (row for batch in batches for row in (dict(zip(batch.schema.names, values, strict=True)) for values in zip(*[c.to_pylist() for c in batch.columns], strict=True)))
    yield from groupby(rows, key=lambda r: r[key])


def _count(size_b: int, stripes: int, best: bool):
    """Sums of a stripe's reports, in dense blocks; with best, also the row maximum of each pair's A id."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "part"):
            stripe, keys, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
            waiting: list[list[np.ndarray]] = []

            def add(keys: np.ndarray, counts: np.ndarray, waiting: list) -> tuple[np.ndarray, np.ndarray]:
                keys, counts = np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[n for _, n in waiting]])
                block = keys // size_b // stripes // BLOCK
                order = np.argsort(block, kind="stable")
                keys, counts, block = keys[order], counts[order], block[order]
                out = []
                for a, b in zip(*_runs(block), strict=True):
                    row, column = keys[a:b] // size_b // stripes % BLOCK, keys[a:b] % size_b
                    dense = np.zeros((BLOCK, size_b), np.int64)
                    np.add.at(dense, (row, column), counts[a:b])
                    r, c = np.nonzero(dense)
                    out.append((((block[a] * BLOCK + r) * stripes + stripe) * size_b + c, dense[r, c]))
                return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])

            for row in rows:
                stripe = row["stripe"]
                waiting.append(_unpack(row["pairs"]))
                if sum(len(k) for k, _ in waiting) >= PAIRS:
                    keys, counts = add(keys, counts, waiting)
                    waiting = []
            if waiting:
                keys, counts = add(keys, counts, waiting)
            most = []
            if best:
                starts, ends = _runs(keys // size_b)  # rows of the dense blocks, in order
                most = [np.repeat(np.maximum.reduceat(counts, starts), ends - starts)]
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([_pack(keys, counts, *most)], pa.binary())], ["stripe", "pairs"])

    return run


def pair_counts(reports: DataFrame, size_b: int, stripes: int = STRIPES) -> DataFrame:
    """One row per stripe with pairs: stripe, pairs (packed: keys, counts and their A ids' best counts). reports: batch (a number of the task), stripe, pairs."""
    spark, n_parts = reports.sparkSession, partitions(reports.sparkSession)
    tasks = reports.groupBy("stripe").count().agg(F.max("count")).first()[0] or 0

    def added(rows: DataFrame, salts: int, best: bool) -> DataFrame:
        keyed = rows.select((F.col("stripe") * salts + F.pmod(F.col("batch"), F.lit(salts))).alias("part"), "stripe", "pairs")
        dealt = keyed.repartition(min(n_parts, stripes * salts), "part").sortWithinPartitions("part")
        return dealt.mapInArrow(_count(size_b, stripes, best), "stripe int, pairs binary")

    while tasks > REPORTS:  # each round leaves a report per salt
        salts = tasks // REPORTS + 1
        reports, tasks = cut(added(reports, salts, False).withColumn("batch", F.monotonically_increasing_id())), salts
    return cut(added(reports, 1, True))


def _score(size_b: int, stripes: int):
    """Of a stripe's counts and the links dealt to the same task: per batch the best links and sums of counts of its documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "part"):
            keys, counts = None, None
            for row in rows:  # the counts come first
                if row["side"] == 0:
                    keys, *counts = _unpack(row["blob"])  # keys in order
                    continue
                local, b, place, times = (x.astype(np.int64) for x in _unpack(row["blob"]))
                at = np.searchsorted(keys, (local * stripes + row["stripe"]) * size_b + b)
                n, most = counts[0][at], counts[1][at]
                docs = int(place.max()) + 1
                best = np.zeros(docs, np.int64)
                total = np.zeros(docs, np.int64)
                np.add.at(best, place, np.where(n == most, times, 0))
                np.add.at(total, place, n * times)
                who = np.unique(place)
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), pa.array([_pack(*(_narrow(x) for x in (who, best[who], total[who])))], pa.binary())], ["batch", "scores"])

    return run


@tidy
def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _grouped(batches, "batch"):
        best, total = np.zeros(BATCH_DOCS, np.int64), np.zeros(BATCH_DOCS, np.int64)
        for row in rows:
            who, n, s = _unpack(row["scores"])
            best[who] += n
            total[who] += s
        who = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([batch] * len(who), pa.int64()), pa.array(who, pa.int32()), pa.array(best[who]), pa.array(total[who])], ["batch", "place", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, size_b = Scratch(spark), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    told = scratch.save(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b, stripes), f"{_TOKENS}, stripe int, links binary, pairs binary"), "aligned")
    counts = pair_counts(told.filter("pairs is not null").select("batch", "stripe", "pairs"), size_b, stripes)

    packed = told.filter("links is not null").select("batch", "stripe", "links")
    sizes = packed.groupBy("stripe").agg(F.ceil(F.sum(F.length("links")) / LINK_BYTES).cast("long").alias("tasks"))
    sizes = F.broadcast(cut(sizes))  # a row per stripe
    part = lambda salt: (F.col("stripe") + F.lit(stripes) * salt).alias("part")
    left = counts.join(sizes, "stripe").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), "stripe", F.col("pairs").alias("blob"))
    left = left.select(part(F.col("salt")), "stripe", F.lit(0).alias("side"), F.lit(None).cast("long").alias("batch"), "blob")
    right = packed.join(sizes, "stripe").select(part(F.pmod(F.xxhash64("batch"), F.col("tasks"))), "stripe", F.lit(1).alias("side"), "batch", F.col("links").alias("blob"))
    dealt = left.unionByName(right).repartition(partitions(spark, told), "part").sortWithinPartitions("part", "side")
    scores = dealt.mapInArrow(_score(size_b, stripes), "batch long, scores binary")
    scores = scores.repartition(partitions(spark), "batch").sortWithinPartitions("batch").mapInArrow(_sum, "batch long, place int, n_best long, count_sum long")

    rows = told.filter("place is not null").select("batch", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.join(scores, ["batch", "place"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
