"""Vectorised word hashing over UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, read off a running sum
and then mixed; all words of a batch of texts cost a few array operations.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: White space of words: the space and the controls 9 to 13.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUES = mix((np.arange(256, dtype=np.uint64) + U64(1)) * GOLDEN)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers = tuple(np.concatenate(([U64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (BASE, _INVERSE))
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a sequence of 64-bit values."""
    up, down = _power(len(values))
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (with the end)."""
    inside = ~SEPARATORS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: bytes, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A to Z lower-cased if ``fold``, and each text's first word (with the end).

    A very long run of texts is hashed in segments that end between words.
    """
    raw = np.frombuffer(data, np.uint8)
    starts, ends, firsts = word_spans(raw, offs)
    table = _FOLDED if fold else _VALUES
    if len(raw) <= SEGMENT:
        return span_hashes(table[raw], starts, ends), firsts
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SEGMENT, side="right")))
        a, b = starts[lo], ends[hi - 1]
        out[lo:hi] = span_hashes(table[raw[a:b]], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out, firsts


def shingle_sets(data: bytes, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles of each text, end to end, and their offsets.

    A text of fewer words has its whole sequence as one shingle; one without words, none.
    """
    words, firsts = word_hashes(data, offs)
    powers = np.cumprod(np.full(width, BASE ^ GOLDEN, np.uint64))
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        whole += words[j : j + len(whole)] * powers[j]
    whole = mix(whole)
    out, sizes = [], np.zeros(len(firsts) - 1, np.int64)
    for i, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
        if b - a >= width:
            own = np.sort(whole[a : b - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix((words[a:b] * powers[: b - a]).sum(dtype=np.uint64, keepdims=True) + U64(b - a))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
