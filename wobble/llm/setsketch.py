"""Shingle sets and SetSketch registers, vectorised over a batch of texts.

A register is the largest of floor(1 - log_b x) over a set's elements, where x is an exponential variable drawn by the
element's hash: a truncated, exponentially spaced minimum. Registers of a union are the maxima of the registers, and
those of two sets agree more often the more the sets share.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Base and rate of the registers; with them 16 bits hold the registers of sets of up to 10**15 elements.
BASE, RATE = 1.01, 20.0


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ in order, and where each text's words end. Null texts have none."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    which = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.asarray(split.offsets)
    ends = (ends - ends[0])[1:].astype(np.int64)
    if b"" in distinct:  # what leads or trails white space
        real = which != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        which = which[real]
    return (table[which] if len(which) else np.zeros(0, np.uint64)), ends


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of k words as sorted 64-bit hashes, one text after the other, and where each ends. Fewer words make one shingle; none make none."""
    n = np.diff(np.concatenate([[0], ends]))
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        h = mix(h + words[j : j + len(h)] + np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero((n > 0) & (n < k))
    inside = owner[: len(h)] == owner[k - 1 :] if len(h) else np.zeros(0, bool)
    short = np.zeros(len(whole), np.uint64)
    for i, d in enumerate(whole.tolist()):
        short[i] = xxhash.xxh3_64_intdigest(words[ends[d] - n[d] : ends[d]].tobytes(), seed=int(n[d]))
    h, owner = np.concatenate([h[inside], short]), np.concatenate([owner[: len(inside)][inside], whole])
    # the owner and the hash's high bits in one number; where that can't tell two hashes of a text apart, by both
    low = np.uint64(len(n).bit_length())
    key = h >> low | owner.astype(np.uint64) << np.uint64(64) - low
    order = np.argsort(key)
    if ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.cumsum(np.bincount(owner[first], minlength=len(n)))


@lru_cache(8)
def multipliers(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(sets: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """m registers, uint16, of each set; zeros for an empty one.

    The largest floor(1 - log_b x) is that of the least x, and x grows with a hash that is uniform on 0..2**64, so the
    least hash is found first and turned to a register once.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    some = np.flatnonzero(np.diff(np.concatenate([[0], ends])) > 0)
    out = np.zeros((len(ends), m), np.uint16)
    if not len(some):
        return out
    least = np.empty((m, len(some)), np.uint64)
    a = multipliers(m)
    at = begins[some]
    step = 1 << 15  # a slice of sets small enough for the processor's cache
    cuts = np.searchsorted(at, np.arange(0, len(sets) + step, step))
    cuts = np.unique(np.append(cuts, len(some)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = sets[at[lo] : at[hi] if hi < len(some) else len(sets)]
        where = at[lo:hi] - at[lo]
        for i in range(m):
            v = part * a[i]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            least[i, lo:hi] = np.minimum.reduceat(v, where)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16).T
    return out


def log_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Log-likelihood of a Jaccard similarity for pairs of sets, from their registers (rows of a and b) and sizes, and the largest similarity that the sizes allow.

    With u and v the sets' shares of na + nb, a register of the first is above the other's with probability p(u - v J),
    below with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def at(j: np.ndarray) -> np.ndarray:
        x, y = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return above * np.log(x) + below * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    return at, np.minimum(u / v, v / u)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood; the likelihood has one maximum."""
    at, hi = log_likelihood(a, b, na, nb)
    lo = np.zeros(len(hi))
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = at(c) > at(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def estimate_reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, level: float) -> np.ndarray:
    """Whether joint_estimate is level or more: whether the likelihood still rises there."""
    at, hi = log_likelihood(a, b, na, nb)
    step = 1e-6
    return (hi > level + step) & (at(np.full(len(hi), level + step)) >= at(np.full(len(hi), level)))
