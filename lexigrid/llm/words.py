"""Words of many texts at once: boundaries and 64-bit hashes from byte arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes that are handled in one piece; a piece ends between texts or between words.
PIECE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space, and of words of letters and digits (which fold A-Z). All bytes of
#: non-ASCII characters belong to words in both.
SPACED = ~_SPACES
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse (modulo 2**64) to the powers 0 to n - 1."""
    size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
    if size not in _POWERS or len(_POWERS[size]) != 2 * size:
        inverse = pow(_BASE, -1, 1 << 64)

        def run(base: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            return np.cumprod(out, dtype=np.uint64)

        if size > PIECE_BYTES + (PIECE_BYTES >> 2):  # one endless text; not kept
            return run(_BASE), run(inverse)
        _POWERS[size] = np.concatenate([run(_BASE), run(inverse)])
    both = _POWERS[size]
    return both[:size], both[size:]


@dataclass
class Words:
    """The words of some texts in order: hash, place in ``data`` and number of words of each text."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Where each text's words begin, and at last their number."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def text_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def split_words(texts: Sequence[str | None], kind: np.ndarray, fold: bool) -> Words:
    """The words of ``texts`` (null: none) of class ``kind``, A-Z lower-cased in hashes and data if ``fold``."""
    encoded = [t.encode() if isinstance(t, str) else b"" for t in texts]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
    data = b"\n".join([*encoded, b""])
    flat = np.frombuffer(data, np.uint8)
    if fold:
        flat = _FOLD[flat]
        data = flat.tobytes()
    inside = kind[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else np.empty(0, np.int64)
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        # As many words as fit into a piece; one at least.
        stop = max(done + 1, int(np.searchsorted(ends, starts[done] + PIECE_BYTES, "right")))
        a, b = int(starts[done]), int(ends[stop - 1])
        up, down = _powers(b - a)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[flat[a:b]] * up[: b - a], dtype=np.uint64, out=sums[1:])
        s, e = starts[done:stop] - a, ends[done:stop] - a
        hashes[done:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        done = stop
    stops = np.cumsum(sizes)
    upto = np.searchsorted(starts, stops)
    return Words(data, mix(hashes), starts, ends, np.diff(upto, prepend=0))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and whether each begins and ends in one text (by first word; the
    last n - 1 places are false)."""
    total = len(words.hashes)
    out, ok = np.zeros(total, np.uint64), np.zeros(total, bool)
    if total >= n:
        acc = words.hashes[: total - n + 1].copy()
        for k in range(1, n):
            acc *= np.uint64(_BASE)
            acc += words.hashes[k : total - n + 1 + k]
        out[: total - n + 1] = mix(acc)
        left = np.repeat(words.firsts[1:], words.counts) - np.arange(total)
        ok = left >= n
    return out, ok
