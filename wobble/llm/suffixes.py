"""Suffix sorting of a block of text by a difference cover.

With a difference cover D of period v, any two positions i and j have a shift d < v for which both i + d and j + d are, mod
v, in D. Positions mod v in D are the sample; their suffixes are ranked once, by doubling over blocks of v bytes. Suffixes
are then sorted by their first v bytes, and those that tie compare by the ranks at the common shift: no tie, however long,
is read beyond v bytes. Memory follows the block, never the text it was cut from.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np

PERIOD = 32


@lru_cache(4)
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set of residues whose differences make all residues mod v; greedy."""
    cover = [0, 1]
    have = {0, 1, v - 1}
    while len(have) < v:
        best = max(range(v), key=lambda c: len({(c - d) % v for d in cover} - have | ({(d - c) % v for d in cover} - have)))
        have |= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return tuple(sorted(set(cover)))


@lru_cache(4)
def shifts(v: int) -> np.ndarray:
    """shifts[a, b]: the least d with a + d and b + d in the cover, mod v."""
    inside = np.zeros(v, bool)
    inside[list(difference_cover(v))] = True
    out = np.full((v, v), -1)
    for d in range(v - 1, -1, -1):
        hit = inside[(np.arange(v) + d) % v]
        out[np.ix_(hit, hit)] = d
    return out


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of rows, the first column weighing most; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


class Block:
    """Strings in one buffer. text: uint8, strings one after the other; ends: where each ends. A string's end sorts before any byte."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, v: int = PERIOD):
        self.v, self.n = v, len(text)
        self.text = np.concatenate([text, np.zeros(v + 8, np.uint8)])
        self.limit = np.repeat(ends, np.diff(np.concatenate([[0], ends])))  # each position's end
        words = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        self.words = np.zeros(self.n + v, np.uint64)
        for k in range(8):
            self.words |= words[: self.n + v, k].astype(np.uint64) << np.uint64(56 - 8 * k)
        cover = np.zeros(v, bool)
        cover[list(difference_cover(v))] = True
        self.sample = np.flatnonzero(cover[np.arange(self.n) % v])
        slot = np.full(self.n + 1, -1)
        slot[self.sample] = np.arange(len(self.sample))
        rank = _dense(self.head(self.sample)) if self.n else np.zeros(0, np.int64)
        step, longest = v, int(np.diff(np.concatenate([[0], ends])).max(initial=0))
        while step < longest:
            to = self.sample + step
            inside = to < self.limit[self.sample]
            nxt = np.zeros(len(rank), np.int64)
            nxt[inside] = rank[slot[to[inside]]]  # step is a multiple of v, so to is in the sample
            rank = _dense([rank, nxt])
            step *= 2
        self.rank = np.zeros(self.n + 1, np.int64)
        self.rank[self.sample] = rank

    def head(self, at: np.ndarray) -> list[np.ndarray]:
        """The first v bytes from each position, up to the string's end, as columns to sort by."""
        left = np.minimum(self.limit[at] - at, self.v)
        out = []
        for k in range(self.v // 8):
            keep = np.clip(left - 8 * k, 0, 8)
            mask = np.where(keep > 0, ~np.uint64(0) << ((8 - np.maximum(keep, 1)) * 8).astype(np.uint64), np.uint64(0))
            out.append(self.words[at + 8 * k] & mask)
        return [*out, left]

    def sort(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Places of `starts` in order of bucket and suffix."""
        heads = self.head(starts)
        residue = starts % self.v
        first = shifts(self.v)[residue, residue]
        at = starts + first
        tail = np.where(at < self.limit[starts], self.rank[np.minimum(at, self.n)], 0)
        order = np.lexsort([residue, tail, *heads[::-1], bucket])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in (bucket, *heads):
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
        edge = np.flatnonzero(new)
        r = residue[order]
        mixed = np.maximum.reduceat(r, edge) != np.minimum.reduceat(r, edge) if len(edge) else np.zeros(0, bool)
        table = shifts(self.v)
        for k in np.flatnonzero(mixed).tolist():  # ties of different residues: each pair has its own shift
            lo, hi = edge[k], edge[k + 1] if k + 1 < len(edge) else len(order)

            def compare(x: int, y: int) -> int:
                d = table[residue[x], residue[y]]
                a, b = starts[x] + d, starts[y] + d
                ra = self.rank[a] if a < self.limit[starts[x]] else 0
                rb = self.rank[b] if b < self.limit[starts[y]] else 0
                return int(ra > rb) - int(ra < rb)

            order[lo:hi] = sorted(order[lo:hi].tolist(), key=cmp_to_key(compare))
        return order


def repeated(block: Block, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which starts share their first `length` bytes with another start of their bucket. All have so many bytes before their string's end."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    order = block.sort(starts, bucket)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(bucket[a] == bucket[b])
    view = np.lib.stride_tricks.sliding_window_view(block.text, length)
    for lo in range(0, len(same), 20_000):
        s = same[lo : lo + 20_000]
        eq = (view[starts[a[s]]] == view[starts[b[s]]]).all(1)
        out[a[s[eq]]] = True
        out[b[s[eq]]] = True
    return out
