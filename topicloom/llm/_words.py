"""Vectorised hashing of the words of many texts.

Words are runs of bytes other than space and 0x09-0x0D (UTF-8 never uses these
bytes inside a character). A word's hash is a polynomial over its bytes modulo
2**64, taken from prefix sums, then mixed; it depends on the word alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = U(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Byte values for word hashes that are independent of the usual ones.
SECOND = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POW, _INV = _powers(_BASE, PIECE + 1), _powers(_BASE_INV, PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _piece(b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw polynomial, start and end of each word of at most PIECE bytes."""
    n = len(b)
    space = np.ones(n + 2, np.int8)
    space[1:-1] = IS_SPACE[b]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(n + 1, U)
    np.cumsum(table[b] * _POW[:n], out=sums[1:], dtype=U)
    return (sums[ends] - sums[starts]) * _INV[starts], starts, ends


def hash_words(texts: list[bytes], lower: bool = False, table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text; table: the values of bytes."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at, total = 0, len(buf)
    while at < total:
        stop = min(at + PIECE, total)
        part = buf[at:stop]
        if lower:
            part = LOWER[part]
        if stop < total:
            back = np.flatnonzero(IS_SPACE[part[-4096:]])
            if not len(back):
                back = np.flatnonzero(IS_SPACE[part])
                cut = back[-1] + 1 if len(back) else 0
            else:
                cut = len(part) - min(4096, len(part)) + back[-1] + 1
        else:
            cut = len(part)
        if cut:
            raw, starts, ends = _piece(part[:cut], table)
            length, first = (ends - starts).astype(U), starts + at
            at += int(cut)
        else:  # one word of more than PIECE bytes: its polynomial is carried from piece to piece
            value, size, first = 0, 0, np.array([at])
            while True:
                part = buf[at : at + PIECE]
                part = LOWER[part] if lower else part
                ends = np.flatnonzero(IS_SPACE[part])
                k = int(ends[0]) if len(ends) else len(part)
                s = int(np.sum(table[part[:k]] * _POW[:k], dtype=U)) if k else 0
                value = (value + s * pow(_BASE, size, 2**64)) % 2**64
                size, at = size + k, at + k
                if len(ends) or at >= total:
                    break
            raw, length = np.array([value], U), np.array([size], U)
        if len(raw):
            hashes.append(mix(raw ^ (length * _STEP)))
            counts += np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=len(texts))[: len(texts)]
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), counts


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (also across texts: the caller masks those)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for j in range(1, k):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += h[j : m + j]
    return mix(out)


def split_points(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about limit at most (one row at least)."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            out.append((start, i))
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
