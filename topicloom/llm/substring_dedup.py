"""Substring dedup on a De Bruijn graph of word k-mers, compacted and verified by source coordinates.

Edges are the windows of K consecutive words of one document (A-Z unchanged),
nodes their overlaps of K - 1 words. A word is removed where a window over it also
starts in a document with a smaller doc_id.

1. Edges: a task hashes the windows of its documents and keeps, of each batch, the
   occurrences in the smallest document that has the edge; for all others a smaller
   document is already known. So a window that sits in a third of all rows leaves a
   batch once. Edges are packed by hash bucket: sorted by document, hash by hash. A
   batch sends at most FAN packets; where more buckets are needed, a second step
   splits each packet's bucket again, so rows do not grow with batches times buckets.
2. A bucket's edges of several documents are the repeated edges; each occurrence
   learns its source coordinate, the first place of the edge in the smallest document.
   What is known of a document comes together by a hash of its id and text, so copies
   of one text do not meet.
3. Paths: joined back to its text, a document's repeated edges that follow each
   other both here and in the source (each step shares a node and none branches
   off) compact into one path: start, number of edges, source, start there. A
   document's paths are one row.
4. Verification: every edge of a path claims that its source has the same words at
   a coordinate. A claim holds a second hash of the window, of other word hashes; the
   distinct claims of a task go to their source, dealt by coordinate, and the source's
   own text answers through a join.
5. Edges whose first hash also belongs to other words (a false claim shows it) are
   decided by the words themselves: all their occurrences meet by text. So equal
   hashes of different windows change no result.
6. Paths join their document and their words are removed.

Defined results: null and blank texts have no words and nothing removed; equal
doc_ids never remove each other's words; a null doc_id counts as the largest.
Repeated rows are treated alike; an empty table gives no rows. Other columns are kept
as they are by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm._spark import Scratch, cut, partitions, release, small_batches, text_key, thinned, tidy
from topicloom.llm._words import SECOND, U, as_bytes, hash_words, mix, roll, split_points
from topicloom.llm._words import roll as roll_again

K = 13
#: Bytes of text hashed together. Edges of one such block are pre-aggregated.
BLOCK = 4 << 20
#: Packets that a block sends at most; more buckets are reached in two steps.
FAN = 1024
#: Claims about a source are dealt out in stretches of so many places.
STARTS = 64
#: Claims that a task remembers having sent (20 bytes each); others are sent again and meet at the source.
SENT = 1 << 20
#: Hashes of several windows that a task looks for at once (8 bytes each).
LOOKED_FOR = 1 << 22
LOSER = np.dtype([("pos", "<u4"), ("src", "<i8"), ("src_pos", "<u4")])
PATH = np.dtype([("start", "<u4"), ("n", "<u4"), ("src", "<i8"), ("src_start", "<u4")])
CLAIM = np.dtype([("src", "<i8"), ("pos", "<u4"), ("value", "<u8")])
_PACKED = "part int, salt int, kind int, payload binary"
EDGES, LOST = 0, 1


def _pack(rec: np.ndarray) -> bytes:
    """Loser records column by column, sources as differences of places: it compresses well."""
    return rec["pos"].tobytes() + rec["src"].tobytes() + (rec["src_pos"] - rec["pos"]).astype("<u4").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // LOSER.itemsize
    rec = np.zeros(n, LOSER)
    rec["pos"] = np.frombuffer(blob, "<u4", n)
    rec["src"] = np.frombuffer(blob, "<i8", n, 4 * n)
    rec["src_pos"] = np.frombuffer(blob, "<u4", n, 12 * n) + rec["pos"]
    return rec


def _pack_docs(ids: np.ndarray, ths: np.ndarray, rec: np.ndarray) -> bytes:
    """Loser records of several documents."""
    by = np.lexsort((rec["pos"], ths, ids))
    ids, ths, rec = ids[by], ths[by], rec[by]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(ths) != 0))))
    counts = np.diff(np.concatenate((first, [len(ids)])))
    return np.array([len(first)], "<i8").tobytes() + ids[first].astype("<i8").tobytes() + ths[first].astype("<i8").tobytes() + counts.astype("<i8").tobytes() + _pack(rec)


def _unpack_docs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (d,) = np.frombuffer(blob, "<i8", 1)
    ids, ths, counts = (np.frombuffer(blob, "<i8", d, 8 + 8 * d * k) for k in range(3))
    return np.repeat(ids, counts), np.repeat(ths, counts), _unpack(blob[8 + 24 * int(d) :])


def _dealt(ids: np.ndarray, ths: np.ndarray, rec: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes]]:
    """Loser records packed by the part of their document, which its id and text decide: copies of a text lie apart."""
    part = (mix(mix(ids.astype(U)) ^ ths.astype(U)) % U(n_parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[by], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        at = by[ends[p] : ends[p + 1]]
        yield p, _pack_docs(ids[at], ths[at], rec[at])


def _gaps(pos: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes]:
    """Places as steps within a document: a byte each, and 255 with a long of its own for wider steps."""
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    wide = step >= 255
    return np.where(wide, 255, step).astype(np.uint8).tobytes(), step[wide].astype("<u4").tobytes()


def _places(small: np.ndarray, wide: np.ndarray, counts: np.ndarray) -> np.ndarray:
    step = small.astype(np.int64)
    step[small == 255] = wide
    total = np.cumsum(step)
    start = np.cumsum(counts) - counts
    before = total[start] - step[start]
    return total - np.repeat(before, counts)


def _dealt_edges(h: np.ndarray, ids: np.ndarray, ths: np.ndarray, pos: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Edges packed by part: of each part the documents, their hashes, and places as steps."""
    by = np.argsort(part, kind="stable")
    h, ids, ths, pos, part = h[by], ids[by], ths[by], pos[by], part[by]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0))).tolist() if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        i, t = ids[a:b], ths[a:b]
        first = np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])))
        runs = np.diff(np.concatenate((np.flatnonzero(first), [b - a])))
        small, wide = _gaps(pos[a:b].astype(np.int64), first)
        head = np.array([b - a, len(runs), len(wide)], "<i8").tobytes()
        yield int(part[a]), head + h[a:b].tobytes() + i[first].astype("<i8").tobytes() + t[first].astype("<i8").tobytes() + runs.astype("<u4").tobytes() + wide + small


def _undealt_edges(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids, text hashes and places."""
    n, d, wide = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    h = np.frombuffer(blob, "<u8", n, at)
    at += 8 * n
    i, t = np.frombuffer(blob, "<i8", d, at), np.frombuffer(blob, "<i8", d, at + 8 * d)
    at += 16 * d
    runs = np.frombuffer(blob, "<u4", d, at).astype(np.int64)
    at += 4 * d
    far = np.frombuffer(blob, "<u4", wide // 4, at)
    pos = _places(np.frombuffer(blob, np.uint8, n, at + wide), far, runs).astype(np.uint32)
    return h, np.repeat(i, runs), np.repeat(t, runs), pos


def _edges(fan: int, salts: int, n_parts: int, k: int):
    """Packed edges for each of fan buckets, and the occurrences that already have a smaller document, by part."""

    def block(ids, ths, texts) -> Iterator[tuple]:
        words, counts = hash_words(texts)
        h = roll(words, k)
        n = len(h)
        if not n:
            return
        doc = np.repeat(np.arange(len(texts)), counts)
        start = np.cumsum(counts) - counts
        valid = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
        h, doc = h[valid], doc[valid]
        pos = valid - start[doc]
        if not len(h):
            return
        by = np.argsort(h, kind="stable")  # documents come by id, so an edge's first is of the smallest
        hs, ds, ps = h[by], doc[by], pos[by]
        head = np.concatenate(([True], hs[1:] != hs[:-1]))
        of = np.cumsum(head) - 1
        lead = np.flatnonzero(head)
        own = ids[ds] == ids[ds[lead]][of]
        lost = np.flatnonzero(~own)
        if len(lost):
            rec = np.zeros(len(lost), LOSER)
            rec["pos"], rec["src"], rec["src_pos"] = ps[lost], ids[ds[lead]][of][lost], ps[lead][of][lost]
            for p, blob in _dealt(ids[ds[lost]], ths[ds[lost]], rec, n_parts):
                yield p, LOST, blob
        keep = np.zeros(len(h), bool)
        keep[by[own]] = True
        h, doc, pos = h[keep], doc[keep], pos[keep]
        for p, blob in _dealt_edges(h, ids[doc], ths[doc], pos, (h % U(fan)).astype(np.int64)):
            yield p, EDGES, blob

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            ids, ths, texts = (sum((h[i] for h in held), []) for i in range(3))
            by = sorted({(i, t): at for at, (i, t) in enumerate(zip(ids, ths, strict=True))}.values(), key=ids.__getitem__)  # repeated rows once
            ids, ths, texts = np.array(ids, np.int64)[by], np.array(ths, np.int64)[by], [texts[i] for i in by]
            for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
                rows = [(p, salt if kind == EDGES else p % salts, kind, blob) for p, kind, blob in block(ids[a:b], ths[a:b], texts[a:b])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "salt", "kind", "payload"])

        held, size = [], 0
        salt = TaskContext.get().partitionId() % salts
        for batch in batches:
            held.append((batch.column("_id").to_pylist(), batch.column("_th").to_pylist(), as_bytes(batch.column("text"))))
            size += sum(map(len, held[-1][2]))
            if size > BLOCK // 2:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _split(fan: int, fine: int):
    """Edges of a bucket's packets, dealt out to the bucket's fine ones. What is known already passes through."""

    def solve(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        h, ids, ths, pos = (np.concatenate(x) for x in zip(*map(_undealt_edges, blobs), strict=True))
        rows = list(_dealt_edges(h, ids, ths, pos, (h // U(fan) % U(fine)).astype(np.int64) * fan + part))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([EDGES] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "salt", "kind", "payload"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs, size = None, [], 0
        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), LOST))
            if known.num_rows:
                yield known
            edges = batch.filter(pc.equal(batch.column("kind"), EDGES))
            for p, blob in zip(edges.column("part").to_pylist(), edges.column("payload").to_pylist(), strict=True):
                if blobs and (p != part or size > 4 * BLOCK):
                    yield solve(part, blobs)
                    blobs, size = [], 0
                part = p
                blobs.append(blob)
                size += len(blob)
        if blobs:
            yield solve(part, blobs)

    return run


def _repeats(n_parts: int):
    """Of a bucket: the occurrences whose edge starts in a smaller document too, by part. Known ones pass through."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hs, ids, ths, pos = zip(*map(_undealt_edges, blobs), strict=True)
        h = np.concatenate(hs)
        by = np.argsort(h, kind="stable")
        h = h[by]
        same = h[1:] == h[:-1]
        several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        by, h = by[several], h[several]
        if not len(h):
            return
        i, t, p = np.concatenate(ids)[by], np.concatenate(ths)[by], np.concatenate(pos)[by]
        order = np.lexsort((p, i, h))
        h, i, t, p = h[order], i[order], t[order], p[order]
        head = np.concatenate(([True], h[1:] != h[:-1]))
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        lost = np.flatnonzero(i != i[lead])
        if not len(lost):
            return
        rec = np.zeros(len(lost), LOSER)
        rec["pos"], rec["src"], rec["src_pos"] = p[lost], i[lead][lost], p[lead][lost]
        rows = list(_dealt(i[lost], t[lost], rec, n_parts))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "payload"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), LOST))
            if known.num_rows:
                yield known.select(["part", "payload"])
            edges = batch.filter(pc.equal(batch.column("kind"), EDGES))
            for p, blob in zip(edges.column("part").to_pylist(), edges.column("payload").to_pylist(), strict=True):
                if p != part and blobs:
                    yield from solve(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from solve(blobs)

    return run


@tidy
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part: a row per document with all its loser records."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        i, t, rec = (np.concatenate(x) for x in zip(*map(_unpack_docs, blobs), strict=True))
        by = np.lexsort((rec["src_pos"], rec["src"], rec["pos"], t, i))
        i, t, rec = i[by], t[by], rec[by]
        new = (np.diff(i) != 0) | (np.diff(t) != 0)
        # a place may be known to several tasks: the smallest source counts
        keep = np.concatenate(([True], new | (np.diff(rec["pos"].astype(np.int64)) != 0)))
        i, t, rec = i[keep], t[keep], rec[keep]
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(i) != 0) | (np.diff(t) != 0)) + 1, [len(i)])).tolist()
        for lo in range(0, len(cuts) - 1, 1000):
            ab = list(zip(cuts[lo : lo + 1000], cuts[lo + 1 : lo + 1001], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(i[[a for a, _ in ab]]), pa.array(t[[a for a, _ in ab]]), pa.array([_pack(rec[a:b]) for a, b in ab], pa.binary())], ["id", "th", "payload"])

    part, blobs = None, []
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if p != part and blobs:
                yield from solve(blobs)
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield from solve(blobs)


def _second(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second hashes of all windows of words, and each text's first word and number of words."""
    words, counts = hash_words(texts, table=SECOND)
    return roll_again(words, k), np.cumsum(counts) - counts, counts


def _distinct(claims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Claims by a hash of theirs, each once, and the hashes."""
    key = mix(mix(claims["src"].astype(U)) ^ claims["value"]) + claims["pos"].astype(U)
    by = np.argsort(key, kind="stable")
    claims, key = claims[by], key[by]
    new = np.concatenate(([True], claims[1:] != claims[:-1]))[: len(claims)]
    return claims[new], key[new]


class _Sent:
    """The claims that a task has sent, as far as it remembers them."""

    def __init__(self):
        self.claims, self.key = np.zeros(0, CLAIM), np.zeros(0, U)

    def new(self, claims: np.ndarray) -> np.ndarray:
        claims, key = _distinct(claims)
        if len(self.key) and len(claims):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            fresh = self.claims[at] != claims
            claims, key = claims[fresh], key[fresh]
        if len(self.key) + len(key) <= SENT:
            both = np.concatenate((self.key, key))
            by = np.argsort(both, kind="stable")
            self.key, self.claims = both[by], np.concatenate((self.claims, claims))[by]
        return claims


def _records(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Loser records of several documents, and the document of each."""
    recs = [_unpack(p) for p in payloads]
    return np.concatenate(recs) if recs else np.zeros(0, LOSER), np.repeat(np.arange(len(recs)), [len(r) for r in recs])


def _claims_of(texts: list[bytes], rec: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    value, start, _ = _second(texts, k)
    out = np.zeros(len(rec), CLAIM)
    out["src"], out["pos"], out["value"] = rec["src"], rec["src_pos"], value[start[doc] + rec["pos"]]
    return out


def _paths(n_parts: int, k: int):
    """A document's repeated edges, compacted into paths: a row per document; and packets of claims about sources, by part."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent = ["id", "th", "part", "payload"], _Sent()
        for batch in batches:
            ids, ths, payloads = batch.column("id"), batch.column("th"), batch.column("payload").to_pylist()
            texts = as_bytes(batch.column("text"))
            for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
                rec, doc = _records(payloads[a:b])
                broken = (np.diff(rec["pos"].astype(np.int64)) != 1) | (np.diff(rec["src"]) != 0) | (np.diff(rec["src_pos"].astype(np.int64)) != 1) | (np.diff(doc) != 0)
                first = np.concatenate(([0], np.flatnonzero(broken) + 1)) if len(rec) else np.zeros(0, int)
                path = np.zeros(len(first), PATH)
                path["start"], path["n"] = rec["pos"][first], np.diff(np.concatenate((first, [len(rec)])))
                path["src"], path["src_start"] = rec["src"][first], rec["src_pos"][first]
                ends = np.searchsorted(doc[first], np.arange(b - a + 1)).tolist()
                packed = [path[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), ths.slice(a, b - a), pa.nulls(b - a, pa.int32()), pa.array(packed, pa.binary())], names)
                claims = sent.new(_claims_of(texts[a:b], rec, doc, k))
                if not len(claims):
                    continue
                part = (mix(mix(claims["src"].astype(U)) + (claims["pos"] // STARTS).astype(U)) % U(n_parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                claims, part = claims[by], part[by]
                starts = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0))).tolist()
                rows = [claims[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(part)], strict=True)]
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(part[starts], pa.int32()), pa.array(rows, pa.binary())], names)

    return run


@tidy
def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's claims: the distinct ones of each stretch of a source."""

    def solve(blobs: list[bytes]) -> pa.RecordBatch:
        claims, _ = _distinct(np.frombuffer(b"".join(blobs), CLAIM))
        claims = claims[np.lexsort((claims["pos"], claims["src"]))]
        new = (np.diff(claims["src"]) != 0) | (np.diff(claims["pos"] // STARTS) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(claims)]
        return pa.RecordBatch.from_arrays([pa.array(claims["src"][cuts[:-1]]), pa.array([claims[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["src", "payload"])

    part, blobs = None, []
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if p != part and blobs:
                yield solve(blobs)
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield solve(blobs)


def _answers(k: int, true: bool):
    """Of the claims about a source: those that its text bears out, or those that it doesn't."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = as_bytes(batch.column("text")), batch.column("asked").to_pylist()
            for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
                value, start, counts = _second(texts[a:b], k)
                blobs = [b"".join(x) for x in asked[a:b]]
                claims = np.frombuffer(b"".join(blobs), CLAIM)
                doc = np.repeat(np.arange(b - a), [len(x) // CLAIM.itemsize for x in blobs])
                inside = claims["pos"].astype(np.int64) + k <= counts[doc]
                at = np.where(inside, start[doc] + claims["pos"], 0)
                ok = inside & (value[at] == claims["value"]) if len(value) else inside
                told = claims[ok == true]
                yield pa.RecordBatch.from_arrays([pa.array(told[c].astype("<u8").view("<i8")) for c in CLAIM.names], ["src", "pos", "value"])

    return run


_CLAIMS = "src long, pos long, value long"


def _ambiguous(false: np.ndarray, k: int):
    """First hashes of the edges whose claims are false."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrong = _distinct(false)[1], set(false.tolist())
        for batch in batches:
            texts, payloads = as_bytes(batch.column("text")), batch.column("payload").to_pylist()
            for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
                rec, doc = _records(payloads[a:b])
                claims = _claims_of(texts[a:b], rec, doc, k)
                own = mix(mix(claims["src"].astype(U)) ^ claims["value"]) + claims["pos"].astype(U)
                hit = key[np.minimum(np.searchsorted(key, own), len(key) - 1)] == own
                hit[hit] = [c in wrong for c in claims[hit].tolist()]
                words, counts = hash_words(texts[a:b])
                start = np.cumsum(counts) - counts
                h = roll(words, k)[(start[doc] + rec["pos"])[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["h"])

    return run


def _occurrences(hashes: np.ndarray, k: int):
    """All windows with one of the first hashes, with their words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, texts = batch.column("_id"), batch.column("_th"), as_bytes(batch.column("text"))
            for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
                words, counts = hash_words(texts[a:b])
                h = roll(words, k)
                doc = np.repeat(np.arange(b - a), counts)
                hit = (hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h) & (doc[: len(h)] == doc[k - 1 : k - 1 + len(h)])
                at = np.flatnonzero(hit)
                which, pos = doc[at], at - (np.cumsum(counts) - counts)[doc[at]]
                split = {d: texts[a + d].split() for d in np.unique(which).tolist()}
                said = [b" ".join(split[d][p : p + k]) for d, p in zip(which.tolist(), pos.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(which)), ths.slice(a, b - a).take(pa.array(which)), pa.array(pos, pa.int64()), pa.array(said, pa.binary())], ["id", "th", "pos", "words"])

    return run


def _by_words(texts: DataFrame, joined: Callable[[], DataFrame], false: DataFrame, k: int) -> DataFrame | None:
    """id, th, edges (pos, lost): the occurrences of windows whose hash other windows share, decided by their words."""
    spark, out = texts.sparkSession, None
    # as many as two different windows of the table share a hash of 64 bits; looked for in parts of bounded size
    claims = ((r["src"], r["pos"], r["value"] % 2**64) for r in false.toLocalIterator())
    found = [joined().mapInArrow(_ambiguous(part, k), "h long") for part in _in_parts(claims, CLAIM)]
    for f in found[1:]:
        found[0] = found[0].unionByName(f)
    hashes = cut(found[0].distinct())
    for part in _in_parts((r["h"] % 2**64 for r in hashes.toLocalIterator()), U):
        rows = texts.mapInArrow(_occurrences(np.sort(part), k), "id long, th long, pos long, words binary")
        out = rows if out is None else out.unionByName(rows)
    spots = cut(out.distinct())
    first = spots.groupBy("words").agg(F.min("id").alias("first"))
    return spots.join(first, "words").groupBy("id", "th").agg(F.collect_list(F.struct("pos", (F.col("first") < F.col("id")).alias("lost"))).alias("edges"))


def _in_parts(values: Iterator, kind) -> Iterator[np.ndarray]:
    while len(part := np.fromiter(islice(values, LOOKED_FOR), kind)):
        yield part


def packed_paths(docs: DataFrame, k: int = K) -> DataFrame:
    """id, th (the row, see text_key), paths (packed PATH records), edges (pos, lost) that the words decided instead: a row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = partitions(spark, docs)
    fine = -(-n_parts // FAN)
    fan = -(-n_parts // fine)
    n_parts = fan * fine
    texts = docs.select(*text_key(), "text")
    scratch = Scratch(spark)
    packed = texts.mapInArrow(_edges(fan, fine, n_parts, k), _PACKED)
    if fine > 1:
        packed = packed.repartition(n_parts, "part", "salt").sortWithinPartitions("part").mapInArrow(_split(fan, fine), _PACKED)
    found = packed.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_repeats(n_parts), "part int, payload binary")
    gathered = found.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_gather, "id long, th long, payload binary")
    losers = scratch.save(gathered, "losers")
    release(spark)
    rows = thinned(texts, "_id", losers, "id").dropDuplicates(["_id", "_th"])
    joined = lambda: rows.join(losers, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th"))).select("id", "th", "text", "payload")
    told = cut(joined().mapInArrow(_paths(n_parts, k), "id long, th long, part int, payload binary"))
    release(spark)
    paths = told.filter("part is null").select("id", "th", F.col("payload").alias("paths"))
    asked = told.filter("part is not null").select("part", "payload").repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_ask, "src long, payload binary")
    ask = cut(asked.groupBy("src").agg(F.collect_list("payload").alias("asked")))  # bounded by the source's length
    release(spark)
    sources = thinned(texts, "_id", ask, "src").join(ask, F.col("_id") == F.col("src")).select("src", "text", "asked")
    false = cut(sources.mapInArrow(_answers(k, False), _CLAIMS).distinct())
    release(spark)
    if not false.isEmpty():  # of several texts of one id, one that bears the claim out is enough
        again = sources.join(false.select(F.col("src").alias("_s")).distinct(), F.col("src") == F.col("_s"), "left_semi").mapInArrow(_answers(k, True), _CLAIMS)
        false = cut(false.join(again.distinct(), ["src", "pos", "value"], "left_anti"))
    out = paths.withColumn("edges", F.lit(None).cast("array<struct<pos: bigint, lost: boolean>>"))
    if not false.isEmpty():
        decided = _by_words(texts, joined, false, k)
        out = cut(paths.join(decided, ["id", "th"], "full"))
    scratch.drop()
    return out


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """Paths as rows: id, th (the row, see text_key), start and n (in edges), src, src_start. Edges decided by words are left out of the paths."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, blob, edges in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "paths", "edges")), strict=True):
                path = np.frombuffer(blob or b"", PATH)
                odd = {e["pos"] for e in edges or ()}
                rows = []
                for p in path.tolist():
                    start, n, src, at = p
                    kept = [x for x in range(n) if start + x not in odd] if odd else None
                    for a, b in [(0, n)] if kept is None else _runs(kept):
                        rows.append((i, t, start + a, b - a, src, at + a))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], ["id", "th", "start", "n", "src", "src_start"])

    return packed_paths(docs, k).mapInArrow(run, "id long, th long, start long, n long, src long, src_start long")


def _runs(places: list[int]) -> list[tuple[int, int]]:
    x = np.array(places)
    cuts = np.flatnonzero(np.diff(x) != 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(x, cuts) if len(p)]


def _with_spans(docs: DataFrame, k: int, *columns: Column) -> DataFrame:
    rows = docs.select(*text_key(), *columns)
    return rows.join(packed_paths(docs, k), (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")), "left").drop("_id", "_th", "id", "th")


def _kept(text: bytes, paths: bytes | None, edges: list[dict] | None, k: int) -> tuple[list[bytes], int]:
    words = text.split()
    if not paths and not edges:
        return words, 0
    path = np.frombuffer(paths or b"", PATH)
    lost = np.zeros(len(words) + 1, np.int32)
    np.add.at(lost, path["start"], 1)
    np.add.at(lost, path["start"].astype(np.int64) + path["n"], -1)
    lost = np.cumsum(lost)[:-1] > 0  # edges that start at a word
    for e in edges or ():
        lost[e["pos"]] = e["lost"]
    at = np.flatnonzero(lost)
    gone = np.zeros(len(words) + 1, np.int32)
    gone[at] += 1
    gone[at + k] -= 1
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in keep.tolist()], len(words) - len(keep)


def dedup_digests(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, paths, edges in zip(as_bytes(batch.column("text")), batch.column("paths").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                words, gone = _kept(text, paths, edges, k)
                n.append(len(words) + gone), removed.append(gone), sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, k, F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with repeated words taken out of text; texts that lose nothing stay as they are, rows and other columns too."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, paths, edges in zip(*(batch.column(c).to_pylist() for c in ("text", "paths", "edges")), strict=True):
                words, gone = _kept(text.encode(), paths, edges, k) if paths or edges else ([], 0)
                out.append(b" ".join(words).decode() if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    kind = docs.schema
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    row = docs.select(rest).schema["row"].dataType.simpleString()
    done = _with_spans(docs, k, rest, F.col("text")).mapInArrow(run, f"row {row}, text string")
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kind.names])
