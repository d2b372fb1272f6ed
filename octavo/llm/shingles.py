"""Vectorised word shingles: 64-bit hashes of every distinct w-word shingle of whole texts.

Works on UTF-8 bytes in numpy, one pass for a block of texts. A word is a maximal run of bytes
outside ``20 09-0D``; A-Z are lower-cased, nothing else is folded. The hash of a shingle depends only
on its words, so equal shingles of any two texts are equal numbers on every machine.
"""

from __future__ import annotations

import numpy as np

_SEED = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: two multiply-xorshift rounds."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MULTIPLIER
    x = x ^ (x >> np.uint64(29))
    x = x * _SEED
    return x ^ (x >> np.uint64(32))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _SEED)
    _BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def _pieces(b: np.ndarray, limit: int):
    """Ranges of about ``limit`` bytes that end where a word ends, so that a long text needs little memory."""
    start = 0
    while start < len(b):
        end = min(start + limit, len(b))
        while end < len(b) and not _BREAK[b[end]]:
            ahead = np.flatnonzero(_BREAK[b[end : end + limit]])
            end += int(ahead[0]) if len(ahead) else limit
        end = min(end, len(b))
        yield start, end
        start = end


def word_hashes(block: bytes, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, hash) of each word in a block of bytes."""
    whole = np.frombuffer(block, dtype=np.uint8)
    found = [(s + start, h) for start, end in _pieces(whole, limit) for s, h in [_word_hashes(whole[start:end])]]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])


def _word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    inside = ~_BREAK[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    if lengths.max() > len(_POWERS):
        _POWERS = _powers(int(lengths.max()) * 2)
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[b[at]] * _POWERS[within], first)
    return starts, mix(sums ^ (lengths.astype(np.uint64) * _SEED))


def _groups(texts, limit: int):
    """Runs of encoded texts of about ``limit`` bytes together, one longer text alone."""
    run, size = [], 0
    for t in texts:
        t = t.as_py() if hasattr(t, "as_py") else t
        t = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def shingle_sets(texts, width: int, limit: int = 1 << 20):
    """Yields for each text, in order, its distinct shingle hashes as a sorted uint64 array.

    A text with fewer than ``width`` words gives its whole word sequence as one shingle; a text
    that is None or has no word gives an empty array. texts may be an Arrow column.
    """
    with np.errstate(over="ignore"):
        for run in _groups(texts, limit):
            sizes = np.fromiter((len(t) + 1 for t in run), dtype=np.int64, count=len(run))
            starts, words = word_hashes(b"\n".join(run) + b"\n")
            owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
            counts = np.bincount(owner, minlength=len(run))
            first = np.cumsum(counts) - counts
            n = len(words)
            if n >= width:
                rolled = np.full(n - width + 1, width, dtype=np.uint64)
                for k in range(width):
                    rolled = rolled * _MULTIPLIER + words[k : n - width + 1 + k]
                whole = owner[: n - width + 1] == owner[width - 1 :]
                rolled, holder = mix(rolled[whole]), owner[: n - width + 1][whole]
            else:
                rolled, holder = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
            for i in np.flatnonzero((counts > 0) & (counts < width)):
                h = np.uint64(counts[i])
                for x in words[first[i] : first[i] + counts[i]]:
                    h = h * _MULTIPLIER + x
                rolled, holder = np.append(rolled, mix(np.array([h], dtype=np.uint64))), np.append(holder, i)
            order = np.lexsort((rolled, holder))
            rolled, holder = rolled[order], holder[order]
            fresh = np.ones(len(rolled), dtype=bool)
            fresh[1:] = (rolled[1:] != rolled[:-1]) | (holder[1:] != holder[:-1])
            rolled, holder = rolled[fresh], holder[fresh]
            cuts = np.searchsorted(holder, np.arange(len(run) + 1))
            for i in range(len(run)):
                yield rolled[cuts[i] : cuts[i + 1]]
