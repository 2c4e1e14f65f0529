"""Exact medians and deviations of many index ranges of one array at once."""

from __future__ import annotations

import numpy as np

from ..functions import MAD_SCALE

#: Ranges handled at once, so that what they look up stays near the processor.
BLOCK = 16_384


class Ranks:
    """Wavelet matrix: the k-th smallest of values[l:r], and how many there are smaller, in as many steps as distinct values have bits."""

    def __init__(self, values: np.ndarray):
        self.distinct, code = np.unique(values, return_inverse=True)
        self.code, self.steps = code, []
        for bit in range(max(1, (len(self.distinct) - 1).bit_length()) - 1, -1, -1):
            up = (code >> bit & 1).astype(bool)
            self.steps.append((bit, np.concatenate(([0], np.cumsum(~up)))))
            code = np.concatenate((code[~up], code[up]))

    def kth(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:  # noqa: E741
        out = np.zeros(len(k), dtype=np.int64)
        for bit, zeros in self.steps:
            zl, zr = zeros[l], zeros[r]
            up = k >= zr - zl
            k = np.where(up, k - (zr - zl), k)
            l, r = np.where(up, zeros[-1] + l - zl, zl), np.where(up, zeros[-1] + r - zr, zr)  # noqa: E741
            out |= up.astype(np.int64) << bit
        return self.distinct[out]

    def below(self, l: np.ndarray, r: np.ndarray, code: np.ndarray) -> np.ndarray:  # noqa: E741
        """How many of values[l:r] have a smaller code; a code beyond all counts the whole range."""
        out, every = np.zeros(len(code), dtype=np.int64), code >= len(self.distinct)
        whole, code = r - l, np.where(every, 0, code)
        for bit, zeros in self.steps:
            zl, zr = zeros[l], zeros[r]
            up = (code >> bit & 1).astype(bool)
            out += np.where(up, zr - zl, 0)
            l, r = np.where(up, zeros[-1] + l - zl, zl), np.where(up, zeros[-1] + r - zr, zr)  # noqa: E741
        return np.where(every, whole, out)


def window_statistics(values: np.ndarray, first: np.ndarray, last: np.ndarray, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and spread, as robust_stats gives them, of values[first:last] without the index but (none: -1).

    The centre of nothing is NaN. Ranges may lie in any order.
    """
    centre, spread = np.full(len(first), np.nan), np.zeros(len(first))
    some = np.flatnonzero(last - first - (but >= 0) > 0)
    ranks = Ranks(values) if len(some) else None
    for i in range(0, len(some), BLOCK):
        at = some[i : i + BLOCK]
        centre[at], spread[at] = _block(ranks, values, first[at], last[at], but[at])
    return centre, spread


def _block(ranks: Ranks, values: np.ndarray, l: np.ndarray, r: np.ndarray, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    without = but >= 0
    n = r - l - without
    code = np.where(without, ranks.code[but], 0)
    place = np.where(without, ranks.below(l, r, code), np.iinfo(np.int64).max)

    def nth(k: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the ranges on, without the one that is left out."""
        return ranks.kth(l[on], r[on], k + (k >= place[on]))

    every = np.arange(len(n))
    c = (nth((n - 1) // 2, every) + nth(n // 2, every)) / 2
    least = np.searchsorted(ranks.distinct, c)
    i = ranks.below(l, r, least) - (without & (code < least))  # how many lie before the centre

    def left(j: np.ndarray, on: np.ndarray) -> np.ndarray:
        """c minus the j-th to the left of the centre; infinite where there is none."""
        there = j < i[on]
        return np.where(there, c[on] - nth(np.where(there, i[on] - 1 - j, 0), on), np.inf)

    def right(j: np.ndarray, on: np.ndarray) -> np.ndarray:
        there = i[on] + j < n[on]
        return np.where(there, nth(np.where(there, i[on] + j, 0), on) - c[on], np.inf)

    k = (n - 1) // 2
    lo, hi = np.maximum(0, k - (n - i)), np.minimum(k, i)
    while len(on := np.flatnonzero(lo < hi)):  # how many of the left side are among the first k
        mid = (lo[on] + hi[on]) // 2
        more = ~(right(k[on] - mid - 1, on) <= left(mid, on))
        lo[on], hi[on] = np.where(more, mid + 1, lo[on]), np.where(more, hi[on], mid)
    a, b = left(lo, every), right(k - lo, every)
    from_left = a <= b
    following = np.fmin(left(lo + from_left, every), right(k - lo + ~from_left, every))
    low = np.fmin(a, b)
    mad = np.where(n % 2 == 1, low, (low + following) / 2) * MAD_SCALE
    flat = np.flatnonzero((n >= 2) & ~(mad > 0))
    spread = np.where(n >= 2, mad, 0.0)
    equal = nth(np.zeros(len(flat), dtype=np.int64), flat) == nth(n[flat] - 1, flat)
    for j, same in zip(flat, equal):
        own = np.concatenate((values[l[j] : but[j]], values[but[j] + 1 : r[j]])) if without[j] else values[l[j] : r[j]]
        spread[j] = 0.0 if same else np.std(own)
    return c, spread
