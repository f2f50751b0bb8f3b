"""Bags of word shingles as sorted 64-bit hashes with counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from riskset.llm.common import U64, mix, word_hashes

WORDS = 5
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F], dtype=U64)
_PAD = U64(0x8EBC6AF09C88C6E3)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``words`` words, number of runs of each text).

    A text with fewer words has one run of all it has; a text without words has none.
    """
    if not 1 <= words <= len(_FACTORS):
        raise ValueError(f"words must be 1 to {len(_FACTORS)}")
    runs = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    total = int(runs.sum())
    if not total:
        return np.zeros(0, U64), runs
    ends = np.repeat(np.cumsum(counts), runs)
    first = np.repeat(np.cumsum(counts) - counts, runs)
    at = first + (np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs))
    out = np.zeros(total, U64)
    for k in range(words):
        j = at + k
        out += np.where(j < ends, hashes[np.minimum(j, len(hashes) - 1)], _PAD) * _FACTORS[k]
    return mix(out), runs


def bags(texts: pa.Array, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, sorted, and how often each occurs."""
    hashes, counts = word_hashes(texts)
    runs, sizes = shingle_hashes(hashes, counts, words)
    ends = np.cumsum(sizes)
    return [np.unique(runs[e - n:e], return_counts=True) for e, n in zip(ends.tolist(), sizes.tolist())]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(size of the multiset intersection, size of the multiset union)."""
    (x, cx), (y, cy) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    total = int(cx.sum() + cy.sum())
    if not len(y):
        return 0, total
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int(np.where(x[at] == y, np.minimum(cx[at], cy), 0).sum())
    return both, total - both
