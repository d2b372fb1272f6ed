"""Sums over all places in a cube round each place, without pairs of places.

One axis is the leaves of a segment tree, so that a range of it is few nodes; each level of the tree is sorted by node
and second axis, so that a node's share of a range is a run of rows; the runs of all queries then go down a wavelet
matrix of the third axis, whose prefix sums give what lies in a range of that. For n places that is
n log(n)**2 steps at most, and fewer where axes have few distinct values. Prefix sums are of whole numbers of 64 bits, so
they add no error: a sum is off by what its terms were rounded by, some 1e-18 each of what the fullest cubes add up to.
"""

from __future__ import annotations

import numpy as np

#: Ranges of the first axis, and copies of a place in them on average, up to which each range is made a run of rows of its
#: own: then a query is one run, not the few nodes of a tree.
SPANS, COPIES = 64, 4
AXES = 3
PAIRS = [(a, b) for a in range(AXES) for b in range(a, AXES)]


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each is there, and a row that each is at."""
    order = np.lexsort(points.T)
    points = points[order]
    first = np.concatenate([[0], 1 + np.flatnonzero((points[1:] != points[:-1]).any(axis=1))])
    return points[first], np.diff(first, append=len(points)), order[first]


def window(values: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted distinct values, the first and past the last that differ by at most half, as differences round."""
    n = len(values)
    low, high = np.searchsorted(values, values - half, "left"), np.searchsorted(values, values + half, "right")
    low, high = np.minimum(low, n - 1), np.maximum(high, 1)
    while (out := values[low] - values < -half).any():
        low = low + out
    while (out := (low > 0) & (values[np.maximum(low - 1, 0)] - values >= -half)).any():
        low = low - out
    while (out := values[high - 1] - values > half).any():
        high = high - out
    while (out := (high < n) & (values[np.minimum(high, n - 1)] - values <= half)).any():
        high = high + out
    return low, high


def _descend(bits_of: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Sum of weights (a row a kind) over places left to right whose number is from low to high (not included), for each query.

    Kinds are added up one at a time, so that a pass stays in the processor's cache.
    """
    n = len(left)
    total = np.zeros((len(weights), n), weights.dtype)
    left, right, ends = np.concatenate([left, left]), np.concatenate([right, right]), np.concatenate([high, low])
    order = np.arange(len(bits_of))
    zeros = np.zeros(len(bits_of) + 1, np.int64)
    for b in range(bits - 1, -1, -1):
        zero = bits_of >> b & 1 == 0
        np.cumsum(zero, out=zeros[1:])
        stable = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])  # faster than to pick by truth
        bits_of, order = bits_of[stable], order[stable]
        held = zeros[-1]
        at, to = zeros[left], zeros[right]
        goes = (ends >> b & 1).astype(bool)
        # Sums of nothing where the query does not go to the ones.
        begin, end = np.where(goes, at, 0), np.where(goes, to, 0)
        sums, first = np.zeros(held + 1, weights.dtype), order[:held]
        for kind, out in zip(weights, total, strict=True):
            np.cumsum(kind[first], out=sums[1:])
            part = sums[end]
            part -= sums[begin]
            out += part[:n]
            out -= part[n:]
        left, right = np.where(goes, held + left - at, at), np.where(goes, held + right - to, to)
    return total


def box_sums(places: np.ndarray, weights: np.ndarray, asked: np.ndarray, half: float) -> np.ndarray:
    """For the places numbered by asked, the sums of the weights (a row a kind) of all places in the cube."""
    values, ranks = zip(*(np.unique(places[:, a], return_inverse=True) for a in range(AXES)), strict=True)
    tree, wave, line = np.argsort([len(v) for v in values], kind="stable")
    ranges = [window(values[a], half) for a in range(AXES)]
    low, high = ([r[i][ranks[a][asked]] for a, r in enumerate(ranges)] for i in (0, 1))
    total = np.zeros((len(weights), len(asked)), weights.dtype)
    bits = len(values[wave]).bit_length()
    spans, span = np.unique(np.stack([low[tree], high[tree]]), axis=1, return_inverse=True)
    ahead = np.concatenate([[0], np.cumsum(np.bincount(ranks[tree]))])
    if len(spans[0]) <= SPANS and (ahead[spans[1]] - ahead[spans[0]]).sum() <= COPIES * len(places):
        in_line = np.argsort(ranks[line], kind="stable")
        node = ranks[tree][in_line]
        for i, (a, b) in enumerate(spans.T):
            at, rows = np.flatnonzero(span == i), in_line[(node >= a) & (node < b)]
            left, right = (np.searchsorted(ranks[line][rows], ends[line][at]) for ends in (low, high))
            total[:, at] = _descend(ranks[wave][rows], weights[:, rows], left, right, low[wave][at], high[wave][at], bits)
        return total
    first, last, level, width = low[tree], high[tree], 0, len(values[line])
    while (live := first < last).any():
        odd, end = live & (first & 1 == 1), live & (last & 1 == 1)
        at = np.concatenate([np.flatnonzero(odd), np.flatnonzero(end)])
        if len(at):
            node = np.concatenate([first[odd], last[end] - 1])
            key = (ranks[tree] >> level) * width + ranks[line]
            order = np.argsort(key, kind="stable")
            key = key[order]
            left, right = np.searchsorted(key, node * width + low[line][at]), np.searchsorted(key, node * width + high[line][at])
            some = np.flatnonzero(left < right)
            if len(some):
                to = at[some]
                found = _descend(ranks[wave][order], weights[:, order], left[some], right[some], low[wave][to], high[wave][to], bits)
                begun = int((some < odd.sum()).sum())  # a query has one node at each end at most
                total[:, to[:begun]] += found[:, :begun]
                total[:, to[begun:]] += found[:, begun:]
        first, last, level = (first + odd) >> 1, (last - end) >> 1, level + 1
    return total


def counts(places: np.ndarray, m: np.ndarray, asked: np.ndarray, half: float) -> np.ndarray:
    return box_sums(places, m[None].astype(np.int64), asked, half)[0]


def _cells(places: np.ndarray, half: float) -> np.ndarray:
    """The number of each place's cell; a cube touches at most 8 of these cells, which are as wide as it is."""
    cells = np.minimum((places - places.min(axis=0)) / (2 * half * (1 + 1e-9)), (1 << 20) - 1).astype(np.int64)
    return np.unique(cells @ np.array([1 << 40, 1 << 20, 1]), return_inverse=True)[1]


def _whole(values: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, int]:
    """Values as whole numbers of a power of two, as fine as lets the sums of a cube stay in 64 bits, and the power.

    Prefix sums may leave 64 bits, but they wrap, so that differences hold.
    """
    most = np.bincount(cell, weights=np.abs(values).astype(np.float64)).max()
    power = 62 - int(np.frexp(8 * most)[1])
    return np.rint(np.ldexp(values, power)).astype(np.int64), power


def moments(places: np.ndarray, m: np.ndarray, asked: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """The number of points in each cube, and the sums of their differences from its place, singly (x, y, z) and as
    products (xx, xy, xz, yy, yz, zz). Where the cube has one place they are exactly zero."""
    # A centre of few bits: coordinates of few bits stay so, and nothing of them is rounded.
    step = np.exp2(np.frexp(np.ptp(places, axis=0).max())[1] - 4.0)
    off = [places[:, a].astype(np.longdouble) - np.rint(places[asked, a].mean() / step) * step for a in range(AXES)]
    cell, weights, powers = _cells(places, half), np.empty((1 + AXES + len(PAIRS), len(places)), np.int64), []
    weights[0] = m
    for a in range(AXES):  # a kind at a time, which bounds the memory beside the places
        weighted = m * off[a]
        for row, values in [(1 + a, weighted), *[(4 + i, weighted * off[b]) for i, (c, b) in enumerate(PAIRS) if c == a]]:
            weights[row], power = _whole(values, cell)
            powers.append((row, power))
    found = box_sums(places, weights, asked, half)
    at, n = [c[asked] for c in off], found[0]
    sums = {row: np.ldexp(found[row].astype(np.longdouble), -power) for row, power in powers}
    single = [sums[1 + a] for a in range(AXES)]
    first = [single[a] - n * at[a] for a in range(AXES)]
    second = [sums[4 + i] - at[a] * single[b] - at[b] * single[a] + n * at[a] * at[b] for i, (a, b) in enumerate(PAIRS)]
    out = np.column_stack([c.astype(np.float64) for c in (*first, *second)])
    out[n == m[asked]] = 0.0
    return n, out
