"""A generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """All substrings of the sequences that were added, one state per class of equal end positions.

    ``step`` follows one symbol: from the longest suffix of what was read that is a substring to the next.
    Symbols are below ``radix``.
    """

    def __init__(self, radix: int):
        self.radix = radix
        self.length = [0]
        self.link = [-1]
        self.next: dict[int, int] = {}
        self._out: list[list[int]] = [[]]

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.length) - 1

    def _edge(self, state: int, symbol: int, to: int) -> None:
        key = state * self.radix + symbol
        if key not in self.next:
            self._out[state].append(symbol)
        self.next[key] = to

    def _split(self, state: int, symbol: int, to: int) -> int:
        """The part of ``to``'s class that ``state`` and ``symbol`` reach: ``to`` itself or a copy of it."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.link[to])
        for s in self._out[to]:
            self._edge(copy, s, self.next[to * self.radix + s])
        self.link[to] = copy
        while state >= 0 and self.next.get(state * self.radix + symbol) == to:
            self.next[state * self.radix + symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: Iterable[int]) -> int:
        """Add all substrings of ``sequence``; returns the state that the whole of it belongs to."""
        at = 0
        for symbol in sequence:
            known = self.next.get(at * self.radix + symbol)
            if known is not None:
                at = self._split(at, symbol, known)
                continue
            new, p = self._state(self.length[at] + 1, 0), at
            while p >= 0 and (p * self.radix + symbol) not in self.next:
                self._edge(p, symbol, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol, self.next[p * self.radix + symbol])
            at = new
        return at

    def find(self, sequence: Sequence[int]) -> int:
        """The state of a known substring, -1 if it is none."""
        at = 0
        for symbol in sequence:
            at = self.next.get(at * self.radix + symbol, -1)
            if at < 0:
                return -1
        return at

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest suffix that is a substring, after one more symbol."""
        while True:
            to = self.next.get(state * self.radix + symbol)
            if to is not None:
                return to, matched + 1
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]

    def packed(self) -> dict[str, np.ndarray | int]:
        """Arrays to hand to other processes."""
        n = len(self.next)
        return {
            "radix": self.radix,
            "keys": np.fromiter(self.next.keys(), np.int64, n),
            "to": np.fromiter(self.next.values(), np.int32, n),
            "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32),
        }

    @classmethod
    def unpacked(cls, arrays: dict) -> SuffixAutomaton:
        """From ``packed``; such an automaton is complete and takes no more sequences."""
        out = cls(arrays["radix"])
        out.next = dict(zip(arrays["keys"].tolist(), arrays["to"].tolist(), strict=True))
        out.link, out.length, out._out = arrays["link"].tolist(), arrays["length"].tolist(), []
        return out
