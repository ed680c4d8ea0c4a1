"""SimHash near-dedup: fingerprints that differ in few bits share a block, so they meet in a block's bucket.

1. A text's words (A-Z in lower case) give three-word shingles, repeats included; each
   is hashed to 64 bits by XXH64 (seed 42). A bit of the fingerprint is 1 if it is set in
   over half of the hashes.
2. Rows of equal fingerprints fall together first; the rest works on distinct ones.
3. Pigeonhole: cut the 64 bits into radius + 1 blocks. Two fingerprints that differ in at
   most radius bits agree on a whole block, so they meet in the bucket of that block
   and value, where their Hamming distance is verified.
4. A bucket of over LIMIT fingerprints is cut again: the bits in which its own fingerprints differ
   make radius + 1 blocks, and by the same argument close pairs share one. Each round fixes a
   quarter of those bits, so after at most seven no bucket can hold more than LIMIT.
5. Of a bucket of over SMALL fingerprints only a spanning forest of its links leaves the
   task (one link less than members), so no group emits its pairs. Links become
   components by min-label propagation.

Defined results: a null text counts as empty; texts without words have fingerprint
zero and are linked like any others; fewer words than a shingle make one of the whole
sequence. Repeated rows give repeated rows. A null doc_id counts as the largest, so a
component of such rows only has a null component_id. An empty table gives no rows.
Texts of any length are hashed in stretches. Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from topicloom.llm._skew import spread_join
from topicloom.llm._spark import THIN_IDS, cut, partitions, small_batches, tidy
from topicloom.llm._words import LOWER, U, as_bytes
from topicloom.llm.near_dedup import NULL_ID, components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a bucket that one task compares with each other; a larger bucket is cut again.
LIMIT = 4096
SMALL = 16
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _stretches(text: bytes) -> Iterator[bytes]:
    """Pieces of about STRETCH bytes that end at white space."""
    at = 0
    while len(text) - at > STRETCH and (m := _SPACE.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _ones(hashes: list[int]) -> np.ndarray:
    """How often each of the 64 bits is set."""
    octets = np.array(hashes, U).view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of UTF-8 text as an unsigned number."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for part in _stretches(text):
        words = last + part.translate(_LOWER).split()
        if len(words) >= k:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - k].tolist()]
            ones += _ones([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)])
            n += len(starts)
            last = words[len(words) - k + 1 :]
        else:
            last = words
    if not n and last:
        ones, n = _ones([xxh64_intdigest(b" ".join(last), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


_LOWER = LOWER.tobytes()


def _describe(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in as_bytes(batch.column("text"))], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints)], ["_id", "fp"])

    return run


def blocks(free: int, radius: int) -> list[int]:
    """Masks (unsigned): all bits that are not free, with one of radius + 1 even blocks of the free ones each."""
    bits = [i for i in range(64) if free >> i & 1]
    edges = [len(bits) * j // (radius + 1) for j in range(radius + 2)]
    return [(2**64 - 1 ^ free) | sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _split(radius: int):
    """Of rows (fp, free): the buckets (fixed bits, their value) of each block."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, free = (batch.column(c).to_numpy().view(U) for c in ("fp", "free"))
            each, at = np.unique(free, return_inverse=True)
            fixed = np.array([blocks(int(f), radius) for f in each], U).reshape(len(each), radius + 1)[at]
            value = fp[:, None] & fixed
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)) for x in (np.repeat(fp, radius + 1), fixed, value)], ["fp", "fixed", "value"])

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints that connect all that links connect, one less than members of a component."""
    left, right, rest, edge = [], [], prints, []
    while len(rest):
        if not edge:
            edge, rest = [rest[0]], rest[1:]
        v = edge.pop()
        near = np.bitwise_count(rest ^ v) <= radius
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), v))
            right.append(found)
            edge.extend(found)
            rest = rest[~near]
    none = np.zeros(0, U)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _pairs(prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; starts: where each begins."""
    sizes = np.diff(np.append(starts, len(prints)))
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    bucket = np.repeat(np.arange(len(starts)), sizes)[small]
    own = prints[small]
    for d in range(1, min(SMALL, len(own))):
        hit = (bucket[d:] == bucket[:-d]) & (np.bitwise_count(own[d:] ^ own[:-d]) <= radius)
        left.append(own[:-d][hit])
        right.append(own[d:][hit])
    for i in np.flatnonzero(sizes > SMALL).tolist():
        a, b = forest(prints[starts[i] : starts[i] + sizes[i]], radius)
        left.append(a)
        right.append(b)
    none = np.zeros(0, U)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _link(radius: int):
    """Of rows (fixed, value, fp) that come bucket by bucket: verified links (a, b), a < b."""

    def told(prints: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in _pairs(prints.view(U), starts, radius))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("fixed", "value", "fp")])], axis=1)
            starts = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
            if len(starts):
                end = starts[-1]
                yield told(held[2, :end].copy(), np.concatenate(([0], starts[:-1])))
                held = held[:, end:]
        if held.shape[1]:
            yield told(held[2].copy(), np.zeros(1, np.int64))

    return run


def links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of the distinct fingerprints fp (long) of prints that connect all that differ in at most radius bits."""
    if limit < 2 ** (radius + 1):
        raise ValueError("limit must be at least 2 ** (radius + 1): narrower buckets cannot be cut again")
    spark = prints.sparkSession
    n_parts, bucket = partitions(spark), ["fixed", "value"]
    solve = lambda keys: keys.repartition(n_parts, *bucket).sortWithinPartitions(*bucket).mapInArrow(_link(radius), "a long, b long")
    rows, found = prints.select("fp", F.lit(-1).cast("long").alias("free")), None
    while True:
        keys = rows.mapInArrow(_split(radius), "fp long, fixed long, value long")
        if found is not None:  # buckets of different rounds' paths may be the same one
            keys = cut(keys.distinct())
        sizes = keys.groupBy(*bucket).agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("free"))
        large = cut(sizes.filter(F.col("n") > limit).select(*bucket, "free"))
        n = large.count()
        if n:
            hint = F.broadcast(large) if n <= THIN_IDS else large
            small, rows = keys.join(hint, bucket, "left_anti"), cut(keys.join(hint, bucket).select("fp", "free").distinct())
        else:
            small = keys
        told = cut(solve(small).distinct())
        found = told if found is None else found.unionByName(told)
        if not n:
            return found.distinct()


def near_components(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_id"), "text")
    told = cut(rows.mapInArrow(_describe(k), "_id long, fp long"))
    prints = cut(told.groupBy("fp").agg(F.min("_id").alias("id"), F.count("*").alias("n")))
    comp = components(links(prints, radius, limit))
    own = prints.join(comp, F.col("fp") == F.col("v"), "left")
    tops = cut(own.filter("l is not null").groupBy("l").agg(F.min("id").alias("top")))
    placed = cut(own.join(tops, "l", "left").select("fp", "n", F.coalesce("top", "id").alias("top")))
    none = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = spread_join(told, placed.select("fp", "top"), "fp", placed)
    return out.select(none("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), none("top").alias("component_id"))
