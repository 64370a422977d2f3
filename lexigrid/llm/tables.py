"""Hash tables over arrays, for many lookups at once."""

from __future__ import annotations

import numpy as np

from .words import mix


class Lookup:
    """An unchanging map from non-negative 64-bit numbers to 32-bit ones (-1: not there), by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self._mask = np.uint64(size - 1)
        self._keys, self._values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            # Of those that want one free place, one gets it; the others try the next place.
            free = rest[self._keys[at[rest]] < 0]
            self._keys[at[free]] = keys[free]
            won = free[self._keys[at[free]] == keys[free]]
            self._values[at[won]] = values[won]
            rest = rest[self._keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & int(self._mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & self._mask).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & int(self._mask)
            found = self._keys[at[rest]]
            same = found == keys[rest]
            out[rest[same]] = self._values[at[rest[same]]]
            rest = rest[~same & (found >= 0)]
        return out


class Remembered:
    """Answers (true or false) to keys, one for each place; a newer key takes the place of an older one."""

    def __init__(self, bits: int):
        self._shift = np.uint64(64 - bits)
        self._keys, self._answers = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def get(self, keys: np.ndarray, work) -> np.ndarray:
        """The answer to each key; ``work`` gives those to keys (by their places in ``keys``) that are not here."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        out = self._answers[at]
        new = np.flatnonzero(self._keys[at] != keys)
        if len(new):
            out[new] = work(new)
            # One key after the other, so that a place holds the answer to its own key.
            self._answers[at[new]] = out[new]
            self._keys[at[new]] = keys[new]
            lost = new[self._keys[at[new]] != keys[new]]
            self._keys[at[lost]] = -1
        return out
