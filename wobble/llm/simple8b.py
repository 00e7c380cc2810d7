"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector (high bits) and 60 bits of payload. Selector s in 0..13 packs COUNTS[s] values of
60 // COUNTS[s] bits each, the first value in the lowest bits. Selector 15 is an escape: its payload is an index to a side
table of raw 64-bit values, for values of more than 60 bits. The stream is cut into blocks of BLOCK values; a block
begins on a word boundary and its last word may be padded with zeros, so blocks decode independently of each other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK = 512


_SMALL = np.concatenate([[0], np.floor(np.log2(np.arange(1, 1 << 16))) + 1]).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if int(values.max()) < len(_SMALL):
        return _SMALL[values.astype(np.uint16)]
    bits = np.zeros(len(values), np.uint8)
    for shift in (48, 32, 16, 0):
        part = (values >> np.uint64(shift)).astype(np.uint64)
        here = (bits == 0) & (part > 0)
        bits[here] = _SMALL[part[here].astype(np.uint16)] + shift
    return bits


class Coded(NamedTuple):
    """n values; words uint64; offsets int64, where each block's words begin, and the end; escapes uint64."""

    n: int
    words: np.ndarray
    offsets: np.ndarray
    escapes: np.ndarray


def encode(values: np.ndarray, block: int = BLOCK) -> Coded:
    """Greedy packing: each word takes the largest count of following values that fits. All blocks advance in lockstep."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return Coded(0, np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64))
    nb = -(-n // block)
    row = block + int(COUNTS[0])  # zeros after each block, so that a last word is padded
    laid = np.zeros((nb, row), np.uint64)
    laid[: n // block, :block] = values[: n - n % block].reshape(-1, block)
    if n % block:
        laid[-1, : n % block] = values[n - n % block :]
    laid = laid.reshape(-1)
    bits = bit_lengths(laid)
    count = np.zeros(len(laid), np.uint8)
    widest, done = bits, 1  # widest[i]: the most bits of `done` values from i on
    for c, w in zip(COUNTS[::-1].tolist(), WIDTHS[::-1].tolist(), strict=True):
        if c > done:
            shifted = np.zeros_like(widest)
            shifted[: done - c] = widest[c - done :]
            widest, done = np.maximum(widest, shifted), c
        fits = widest <= w
        if not fits.any():
            break  # more values in narrower lanes fit nowhere either
        np.maximum(count, fits.view(np.uint8) * np.uint8(c), out=count)
    take = np.maximum(count, 1).astype(np.int32)
    pos = np.arange(nb) * row
    end = pos + block
    end[-1] = pos[-1] + n - (nb - 1) * block
    begins = np.zeros(len(laid), bool)
    while len(pos):
        begins[pos] = True
        pos = pos + take[pos]
        more = pos < end
        if not more.all():
            pos, end = pos[more], end[more]
    start = np.flatnonzero(begins)
    per_block = np.bincount(start // row, minlength=nb)
    got = count[start]
    words = np.zeros(len(start), np.uint64)
    for c in np.unique(got).tolist():
        rows = np.flatnonzero(got == c)
        if not c:
            words[rows] = np.arange(len(rows), dtype=np.uint64) | np.uint64(ESCAPE << 60)
            continue
        s = int(np.flatnonzero(COUNTS == c)[0])
        at, w = start[rows], int(WIDTHS[s])
        word = np.full(len(rows), s << 60, np.uint64)
        for k in range(c):
            word |= laid[at + k] << np.uint64(k * w)
        words[rows] = word
    return Coded(n, words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64), laid[start[got == 0]])


def decode(coded: Coded, block: int = BLOCK) -> np.ndarray:
    """The values, uint64. Words of one selector unpack together."""
    n, words, offsets, escapes = coded
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.ones(len(words), np.int64)
    plain = sel < len(COUNTS)
    counts[plain] = COUNTS[sel[plain]]
    before = np.cumsum(counts) - counts
    first = offsets[:-1]
    owner = np.repeat(np.arange(len(first)), np.diff(offsets))
    start = before - before[first][owner] + owner * block
    stop = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        c, w, at, end = int(COUNTS[s]), int(WIDTHS[s]), start[rows], stop[rows]
        coded_words, mask = words[rows], np.uint64((1 << w) - 1)
        full = at + c <= end
        for k in range(c):  # only a block's last word may be cut short
            there = full if k else slice(None)
            out[at[there] + k] = (coded_words[there] >> np.uint64(k * w)) & mask
        for r in np.flatnonzero(~full).tolist():
            k = np.arange(end[r] - at[r])
            out[at[r] : end[r]] = (coded_words[r] >> (k * w).astype(np.uint64)) & mask
    return out


def decode_block(coded: Coded, k: int, block: int = BLOCK) -> np.ndarray:
    """One block alone, by its offset."""
    a, b = int(coded.offsets[k]), int(coded.offsets[k + 1])
    n = min(block, coded.n - k * block)
    return decode(Coded(n, coded.words[a:b], np.array([0, b - a]), coded.escapes), block)
