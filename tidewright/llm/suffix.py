"""Suffix arrays by the difference-cover algorithm, on whole numpy arrays."""

from __future__ import annotations

import numpy as np

#: Keys stay below this.
MOST = 2**63


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    line = key[order]
    rank = np.concatenate([[1], 1 + np.cumsum(line[1:] != line[:-1])])
    return order, rank, int(rank[-1])


def _joined(high: np.ndarray, low: np.ndarray, base: int) -> np.ndarray:
    """Keys in the order of (high, low), low < base; high is renamed where the product would not fit a long."""
    top = int(high.max(initial=0)) + 1
    if top * base > MOST:
        high = np.unique(high, return_inverse=True)[1]
        top = int(high.max(initial=0)) + 1
        if top * base > MOST:
            raise OverflowError("too many codes for one suffix array")
    return high * base + low


def suffix_array(codes: np.ndarray, top: int) -> np.ndarray:
    """Start positions of all suffixes of ``codes`` (integers from 1 to ``top``) in lexicographic order.

    Positions not divisible by three are the sample. Their triples are sorted and named; where names repeat, the
    string of names is solved by recursion. The other suffixes are ordered by (first code, rank of the next
    sample suffix) and merged: a suffix at 0 mod 3 meets one at 1 mod 3 by (code, rank) and one at 2 mod 3 by
    (code, code, rank), so a binary search in each class gives every suffix its final place.
    """
    n = len(codes)
    if (top + 1) ** 2 > MOST or (top + 1) * (n + 4) > MOST:
        codes = np.unique(codes, return_inverse=True)[1] + 1
        top = int(codes.max(initial=0))
    if n <= 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    s = np.concatenate([codes.astype(np.int64), np.zeros(4, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one past the end keeps the two halves of the recursion apart
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    base = top + 1
    order, rank, most = _names(_joined(s[sample] * base + s[sample + 1], s[sample + 2], base))
    name = np.empty(len(sample), np.int64)
    name[order] = rank
    if most < len(sample):
        order = suffix_array(name, most)
        name[order] = np.arange(1, len(sample) + 1)
    ranks = np.zeros(n + 4, np.int64)
    ranks[sample] = name
    sample = sample[order]
    sample = sample[sample < n]
    zeros = np.arange(0, n, 3)
    wide = n + 4
    zero_key = s[zeros] * wide + ranks[zeros + 1]
    zeros = zeros[np.argsort(zero_key, kind="stable")]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    place = np.arange(len(zeros))
    place = place + np.searchsorted(s[first] * wide + ranks[first + 1], s[zeros] * wide + ranks[zeros + 1])
    both = np.concatenate([second, zeros])
    key = _joined(s[both] * base + s[both + 1], ranks[both + 2], wide)
    place = place + np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = sample
    return out


def equal_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``data[a:a+length] == data[b:b+length]``, pair by pair; data must reach past all of them."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    alive = np.arange(len(a))
    for step in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[a[alive] + step] == words[b[alive] + step]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out
