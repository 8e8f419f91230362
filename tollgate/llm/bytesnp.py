"""Word and shingle hashes of text batches in NumPy, over the flat UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so temporary arrays stay small;
#: one longer text is a slice of its own.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value per byte (as is, and with A-Z lower-cased); each byte's kind:
    0 space, 1 letter, digit or part of a longer code, 2 other ASCII."""
    rng = np.random.Generator(np.random.PCG64(20240))
    as_is = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    lower = as_is.copy()
    lower[65:91] = as_is[97:123]
    kinds = np.ones(256, np.uint8)
    kinds[[b for b in range(128) if not chr(b).isalnum()]] = 2
    kinds[[32, 9, 10, 11, 12, 13]] = 0
    return as_is, lower, kinds


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2^64, and of its inverse."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE + 1)
        inv = pow(_BASE, -1, 1 << 64)
        for name, b in (("p", _BASE), ("q", inv)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n + 1 offsets into them."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `size` bytes."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice's texts, in order, and each text's number of words.

    Words lie between spaces; with `marks`, runs of ASCII punctuation are words of their own."""
    as_is, low, kinds = _tables()
    base = offsets[0]
    part, at = data[base:offsets[-1]], offsets - base
    n = len(part)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    kind = kinds[part] if marks else kinds[part] > 0
    edge = np.ones(n + 1, bool)  # where a run of one kind begins or the text ends
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True  # a word never crosses texts
    runs = np.flatnonzero(edge)
    words = kind[runs[:-1]] > 0
    s, e = runs[:-1][words], runs[1:][words]
    p, q = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low if lower else as_is)[part] * p, out=total[1:])
    h = mix((total[e] - total[s]) * q[s])
    counts = np.searchsorted(s, at[1:]) - np.searchsorted(s, at[:-1])
    return h, counts


def long_word_hashes(data: np.ndarray, lo: int, hi: int, lower: bool = True) -> np.ndarray:
    """`word_hashes` of one text data[lo:hi] of any length, in runs of `SLICE` bytes cut at spaces."""
    as_is, low, kinds = _tables()
    found = []
    while lo < hi:
        end = min(lo + SLICE, hi)
        if end < hi:
            gaps = np.flatnonzero(kinds[data[lo:end]] == 0)
            if not len(gaps):  # one word longer than a run: its sum is taken by parts
                p, _ = powers(SLICE)
                total, at, step = 0, lo, pow(_BASE, SLICE, 1 << 64)
                scale = 1
                while at < hi:
                    part = data[at:min(at + SLICE, hi)]
                    gap = np.flatnonzero(kinds[part] == 0)
                    part = part[:gap[0]] if len(gap) else part
                    value = int(((low if lower else as_is)[part] * p[:len(part)]).sum(dtype=np.uint64))
                    total, scale, at = (total + value * scale) % (1 << 64), scale * step % (1 << 64), at + len(part)
                    if len(gap):
                        break
                found.append(mix(np.array([total], np.uint64)))
                lo = at
                continue
            end = lo + int(gaps[-1]) + 1
        found.append(word_hashes(data, np.array([lo, end]), lower)[0])
        lo = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as (owner, hash), sorted by both, and their number;
    a text with fewer words, but some, has its whole sequence as one."""
    if len(counts) == 1 and len(h) >= k:  # one text, maybe a very long one
        acc = h[:len(h) - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * np.uint64(_BASE) + h[j:len(acc) + j])
        acc = np.unique(acc)
        return np.zeros(len(acc), np.int64), acc, np.array([len(acc)])
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.cumsum(counts)
    left = np.repeat(end, counts) - np.arange(len(h))  # words from here to the text's end
    total = np.repeat(counts, counts)
    acc = h.copy()
    for j in range(1, k):
        has = np.flatnonzero(left > j)
        acc[has] = mix(acc[has] * np.uint64(_BASE) + h[has + j])
    first = left == total
    keep = (left >= k) | (first & (total < k))
    owner, acc = owner[keep], acc[keep]
    order = np.lexsort((acc, owner))
    owner, acc = owner[order], acc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    owner, acc = owner[new], acc[new]
    return owner, acc, np.bincount(owner, minlength=len(counts))
