"""Interpolated modified Kneser-Ney over byte n-grams, as ordered arrays.

A level holds distinct n-grams and their counts: of the longest n-grams how often they occur, of
shorter ones how many different symbols precede them. Codes are those of grams.byte_codes.
"""

from __future__ import annotations

import numpy as np

from .grams import positions_in, runs

ORDER = 4  # symbols of context
SYMBOLS = 256


def mask(symbols: int) -> np.uint64:
    return np.uint64((1 << 8 * symbols) - 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """(0, D1, D2, D3+) from how many n-grams have the counts 1, 2, 3 and 4."""
    n = np.maximum(np.asarray(n, float), 1)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [j - (j + 1) * y * n[j] / n[j - 1] for j in (1, 2, 3)]
    return np.array([0, *(np.clip(d, 0.1, j - 0.05) for j, d in enumerate(raw, 1))])


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]


def continuations(grams: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their first symbol (``symbols`` remain), and how many symbols precede each."""
    return runs(np.sort(grams & mask(symbols)))


class Level:
    def __init__(self, grams: np.ndarray, counts: np.ndarray, discount: np.ndarray | None = None):
        d = discounts(count_of_counts(counts)) if discount is None else discount
        taken = d[np.minimum(counts, 3).astype(np.int64)]
        self.grams, self.kept = grams, np.maximum(counts - taken, 0)
        self.contexts, sizes = runs(grams >> np.uint64(8))
        first = np.cumsum(sizes) - sizes
        some = len(grams) > 0
        self.total = np.add.reduceat(counts, first).astype(float) if some else np.zeros(0)
        self.left = (np.add.reduceat(np.minimum(taken, counts), first) if some else np.zeros(0)) / self.total

    def refine(self, p: np.ndarray, codes: np.ndarray, symbols: int) -> np.ndarray:
        """The probability of each code's last symbol after symbols-1 others, given that after one fewer."""
        if not len(self.grams):
            return p
        grams = codes & mask(symbols)
        context = positions_in(self.contexts, grams >> np.uint64(8))
        at = positions_in(self.grams, grams)
        own = np.where(at >= 0, self.kept[at], 0) / self.total[context]
        return np.where(context >= 0, own + self.left[context] * p, p)


def lower_levels(grams: np.ndarray, order: int = ORDER) -> list[Level]:
    """Levels for 1 to ``order`` symbols from the distinct n-grams of order + 1 symbols."""
    levels = []
    for symbols in range(order, 0, -1):
        grams, counts = continuations(grams, symbols)
        levels.append(Level(grams, counts))
    return levels[::-1]


def probability(codes: np.ndarray, levels: list[Level]) -> np.ndarray:
    p = np.full(len(codes), 1 / SYMBOLS)
    for symbols, level in enumerate(levels, 1):
        p = level.refine(p, codes, symbols)
    return p
