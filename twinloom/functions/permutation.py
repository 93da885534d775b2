"""Seeded permutations of 0..n-1 that are evaluated one place at a time.

A place is written as two digits of about the square root of n; rounds add a keyed number of
one digit to the other, which can be undone, so the digits are permuted. Their range is a
little larger than n: a place that lands beyond n is permuted again until it lands inside,
which keeps the mapping one to one. ``contract.sqltext`` holds the same recipe as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from twinloom.functions.counter import uniform_grid, uniform_pairs

ROUNDS = 6


def digits(n: int) -> tuple[int, int]:
    """Ranges of the two digits: the first is the least number whose square is at least ``n``."""
    first = math.isqrt(max(n, 1) - 1) + 1
    return first, -(-max(n, 1) // first)


def permuted(stream: int, seeds: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Where the permutation of each seed puts the place beside it; all places are below ``n``."""
    a, b = digits(n)
    out = np.array(places, np.int64)
    seeds = np.asarray(seeds, np.int64)
    left = np.arange(len(out))
    while len(left):
        high, low = out[left] // b, out[left] % b
        for k in range(0, ROUNDS, 2):
            high = (high + (uniform_pairs(stream + k, seeds[left], low) * a).astype(np.int64)) % a
            low = (low + (uniform_pairs(stream + k + 1, seeds[left], high) * b).astype(np.int64)) % b
        out[left] = high * b + low
        left = left[out[left] >= n]
    return out


class Backwards:
    """The permutations of 0..n-1 read from their ends: which place is put at each of some spots.

    A round's number depends on the seed and one digit, so a seed needs tables of about the
    square root of n only, whatever the number of spots.
    """

    def __init__(self, stream: int, spots: np.ndarray, n: int):
        self.stream, self.n = stream, n
        self.a, self.b = digits(n)
        self.high, self.low = np.divmod(np.asarray(spots, np.int64), self.b)

    def _tables(self, seeds: np.ndarray) -> list[np.ndarray]:
        """Per round the numbers of each seed, one line a seed."""
        out = []
        for k in range(ROUNDS):
            own, other = (self.b, self.a) if k % 2 == 0 else (self.a, self.b)
            out.append((uniform_grid(self.stream + k, seeds, np.arange(own)) * other).astype(np.int64))
        return out

    def places(self, seed: int) -> np.ndarray:
        return next(self.places_of([seed]))

    def places_of(self, seeds: list[int]) -> Iterator[np.ndarray]:
        """``places`` of several seeds, whose tables are made at once."""
        of_all = self._tables(np.asarray(seeds, np.int64))
        for line in range(len(seeds)):
            tables = [t[line] for t in of_all]
            out = self._back(tables, self.high, self.low)
            left = np.flatnonzero(out >= self.n)
            while len(left):
                out[left] = self._back(tables, *np.divmod(out[left], self.b))
                left = left[out[left] >= self.n]
            yield out

    def _back(self, tables: list[np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
        for k in range(ROUNDS - 2, -1, -2):
            low = low - tables[k + 1][high]
            low += (low >> 63) & self.b
            high = high - tables[k][low]
            high += (high >> 63) & self.a
        return high * self.b + low
