"""Word shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

import numpy as np

from .common import Rolling, join_texts, mix64, words_of

_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_hashes(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words, in order. A text with fewer words, but
    one at least, is one shorter run; one without words has none. White space between words
    doesn't matter; case does."""
    data, starts = join_texts(texts)
    begin, end, first = words_of(data, starts)
    counts = np.diff(first)
    words = Rolling(data).of(begin, end)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), runs)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = first[:-1][owner] + within
    last = first[1:][owner]
    out = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            inside = at + j < last
            out = out * _STEP + np.where(inside, words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(j + 1)).astype(np.uint64)
    return owner, mix64(out, size)


def weighted_cells(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell), sorted by both: a shingle of weight w (its count in the text) is w
    cells, its first, second ... region of unit weight. The plain Jaccard similarity of two texts'
    cells is the weighted Jaccard similarity of their shingle counts."""
    owner, hashes = shingle_hashes(texts, size)
    # Equal hashes of a text are interchangeable, and texts of a batch few: two sorts of single numbers.
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.arange(len(owner))
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    cells = np.where(occurrence == 0, hashes, mix64(hashes + occurrence.astype(np.uint64) * _STEP, 9))
    return owner, cells


def similarities(left: list[str | None], right: list[str | None], size: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts; 0 without shingles."""
    n = len(left)
    a, x = weighted_cells(left, size)
    b, y = weighted_cells(right, size)
    pair, cell = np.concatenate((a, b)), np.concatenate((x, y))
    order = np.lexsort((cell, pair))
    pair, cell = pair[order], cell[order]
    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (cell[1:] == cell[:-1])], minlength=n)
    every = np.bincount(pair, minlength=n)
    return both / np.maximum(every - both, 1)
