"""Vectorised word scanning over UTF-8 buffers (numpy): positions and 64-bit hashes of words."""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def class_table(is_word) -> np.ndarray:
    """Boolean table over byte values from a predicate."""
    return np.array([bool(is_word(b)) for b in range(256)])


NOT_SPACE = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: After lower-casing: digits, a-z and everything beyond ASCII.
ALNUM_OR_WIDE = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


#: Masks that keep the first k bytes of a lane, and constants of the two hash functions.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
#: Spans with more lanes are hashed one by one, so that a long one doesn't cost a pass for each lane.
_MOST_LANES = 32


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a 64-bit number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).copy()


def span_hash(data: np.ndarray, lane: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of ``data``, whose lanes are given: a chain of bijective
    steps over the lanes of a span, so that no sum or product of bytes can cancel out; spans of more
    than ``_MOST_LANES`` lanes by BLAKE2b. ``which`` (0 or 1) names one of two independent functions."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(U64) * _SEEDS[which] + _SEEDS[1 - which])
    long_ = size > 8 * _MOST_LANES
    live = np.flatnonzero(~long_ & (size > 0))
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix((out[live] ^ (lane[at] & _FIRST[np.minimum(left, 8)])) + _SEEDS[which])
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(long_).tolist():
        made = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([which])).digest()
        out[i] = np.frombuffer(made, U64)[0]
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every maximal run of bytes in ``table``; runs don't cross rows.

    ``data`` must be lower-cased already. Hashes depend on the word alone."""
    inside = table[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets[1:], start, side="right")
    return span_hash(data, lanes(data), start, end), row, start, end


def windows(word_hash: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of ``n`` words within one row."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.flatnonzero(row[:count] == row[n - 1 :])
    total = np.full(count, U64(n), U64)
    weight = 1
    for k in range(n):
        weight = (weight * 0xC6BC279692B5C323 + 2 * k + 1) & ((1 << 64) - 1) | 1
        total += word_hash[k : k + count] * U64(weight)
    return first, mix(total[first])
