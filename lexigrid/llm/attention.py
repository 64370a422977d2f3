"""A small causal self-attention language model in numpy over subword ids.

Units are the words that a vocabulary has (those of a public one that are one token, and the frequent words of the
training texts), and two bytes at a time of all other words with one space behind them. The model gives P(unit | before) = P(class of the unit | window before) * P(unit | its class, the unit before). The second
factor comes from counts over all training texts, the first from those counts and a layer of masked
self-attention over the window, whose logits are added to theirs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .words import SPACED, Words, split_words

#: Ids of units: two bytes, the end of a text (also what stands before its first unit), then whole words.
END = 1 << 16
#: Units that the model tells apart (the rest are one, OTHER), classes, width, and the window's sizes.
KNOWN, CLASSES, WIDTH = 2500, 32, 12
WINDOW, CONTEXT = 16, 4
STEP = WINDOW - CONTEXT
#: Characters of texts whose units are handled together.
PIECE_CHARS = 1 << 20


def pieces(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of ``texts`` of PIECE_CHARS or so; a longer text is one of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if k > first and held + n > PIECE_CHARS:
            yield slice(first, k)
            first, held = k, 0
        held += n
    if len(texts) > first:
        yield slice(first, len(texts))


class Vocabulary:
    """Whole words of a public vocabulary, lower-cased: sorted hashes, and the unit of each."""

    def __init__(self, words: list[bytes]):
        known = split_words([w.decode() for w in words], SPACED, True)
        self._hold(known.hashes)

    def _hold(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.size = END + 1 + len(self.hashes)
        # By the last bits of a hash: a word that has them (-1: none), and whether others do.
        low = (self.hashes & np.uint64(0xFFFFF)).astype(np.int64)
        self._slot = np.full(1 << 20, -1, np.int32)
        self._slot[low] = np.arange(len(low))
        self._shared = np.bincount(low, minlength=1 << 20) > 1

    @classmethod
    def of_file(cls, path: str | None = None) -> Vocabulary:
        """Tokens that are a space and letters, of a byte-level BPE file."""
        from . import bpe

        with open(path or bpe.default_vocabulary(), encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        letters = bpe.byte_letters()
        found = (bytes(letters[c] for c in t[1:]) for t in tokens if len(t) > 1 and letters.get(t[0]) == 0x20 and all(c in letters for c in t))
        return cls(sorted({w for w in found if w.isalpha()}))

    def with_words(self, hashes: np.ndarray) -> Vocabulary:
        """This vocabulary and the words with these hashes."""
        out = Vocabulary([])
        out._hold(np.concatenate([self.hashes, hashes.astype(np.uint64)]))
        return out

    def units_of(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each word that is one, else -1."""
        out = np.full(len(hashes), -1, np.int32)
        low = (hashes & np.uint64(0xFFFFF)).astype(np.int64)
        slot = self._slot[low]
        maybe = np.flatnonzero(slot >= 0)
        at = slot[maybe]
        several = self._shared[low[maybe]]
        at[several] = np.minimum(np.searchsorted(self.hashes, hashes[maybe[several]]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe] if len(maybe) else np.empty(0, bool)
        out[maybe[same]] = END + 1 + at[same]
        return out


def units(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, Words]:
    """Unit ids of all texts one after another, each with END behind it, and their numbers."""
    return _units(texts, vocabulary)[:3]


def _units(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """What ``units`` has, and the number of units of each word."""
    words = split_words(texts, SPACED, True)
    flat = np.frombuffer(words.data, np.uint8)
    whole = vocabulary.units_of(words.hashes)
    one = whole >= 0
    size = np.where(one, 1, (words.ends - words.starts + 2) // 2)
    total = int(size.sum())
    text = np.repeat(np.arange(len(texts)), words.counts)
    begin = np.cumsum(size) - size + text
    out = np.full(total + len(texts), END, np.int32)
    out[begin[one]] = whole[one]
    spelt = np.flatnonzero(~one)
    n = size[spelt]
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place, stop = np.repeat(words.starts[spelt], n) + 2 * nth, np.repeat(words.ends[spelt], n)
    first = np.where(place < stop, flat[np.minimum(place, len(flat) - 1)], 0x20)
    second = np.where(place + 1 < stop, flat[np.minimum(place + 1, len(flat) - 1)], np.where(place + 1 == stop, 0x20, 0))
    out[np.repeat(begin[spelt], n) + nth] = first.astype(np.int32) << 8 | second
    counts = np.bincount(text, size, len(texts)).astype(np.int64) + 1
    return out, counts, words, size


@dataclass
class Tables:
    """What counts over the training texts say: the known units, and log probabilities of units and classes after each."""

    number: np.ndarray  # of a unit id; the last number is OTHER
    of_class: np.ndarray
    within: np.ndarray  # log P(unit | class, before), float32
    classes: np.ndarray  # log P(class | before), float32
    rare: np.ndarray  # log P(unit id | OTHER) of the units that are not known ones, 0 for those, float32


def numbers(units: int, top: np.ndarray) -> np.ndarray:
    """The number of each of ``units`` unit ids: its place in ``top``, or that behind the last one (OTHER)."""
    number = np.full(units, len(top), np.int32)
    number[top] = np.arange(len(top))
    return number


def make_tables(before: np.ndarray, unit: np.ndarray, n: np.ndarray, top: np.ndarray, single: np.ndarray, smoothing: float = 4.0) -> Tables:
    """From pair counts over known units; ``top`` lists the ids of known units, END first, ``single`` has the count of every unit id."""
    pairs = np.zeros((len(top) + 1, len(top) + 1), np.float32)
    np.add.at(pairs, (before, unit), n)
    return tables_of(pairs, top, single, smoothing)


def tables_of(pairs: np.ndarray, top: np.ndarray, single: np.ndarray, smoothing: float = 4.0) -> Tables:
    """``make_tables`` from a square array of counts, which is used up."""
    size = len(pairs)
    number = numbers(len(single), top)
    # All counts of the corpus tell the other units apart; one that it lacks counts as one.
    rare = np.where(number == size - 1, single + 1.0, 0.0)
    rare = np.where(rare > 0, np.log(np.maximum(rare, 1.0)) - np.log(max(rare.sum(), 1.0)), 0.0).astype(np.float32)
    of_class = _clusters(pairs)
    share = pairs.sum(0) + 1.0
    share /= share.sum()
    below = pairs.sum(1, keepdims=True) + smoothing
    p = pairs
    p += smoothing * share
    p /= below
    member = np.zeros((size, CLASSES), np.float32)
    member[np.arange(size), of_class] = 1
    by_class = np.log(np.maximum(p @ member, np.float32(1e-30)))  # of classes without units too
    np.log(p, out=p)
    for k in range(0, size, 256):
        p[k : k + 256] -= by_class[k : k + 256, of_class]
    return Tables(number, of_class, p, by_class, rare)


def _clusters(pairs: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Units with like neighbours on the left, by k-means over their profiles."""
    weight = pairs.sum(0)
    heads = np.argsort(-pairs.sum(1), kind="stable")[:128]
    x = np.sqrt((pairs[heads].T + 0.01) / (weight[:, None] + 0.01 * len(heads)))
    order = np.argsort(-weight, kind="stable")
    centres = x[order[:: max(1, min(len(x), 8 * CLASSES) // CLASSES)][:CLASSES]]
    centres = np.vstack([centres, np.zeros((CLASSES - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        for c in range(CLASSES):
            own = near == c
            if own.any():
                centres[c] = np.average(x[own], 0, weight[own] + 1e-3)
    return near.astype(np.int32)


def cut_windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows over texts of ``counts`` units begin, and how many of their first places are context only."""
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // STEP))
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    firsts = np.cumsum(counts) - counts
    return firsts[text] + nth * STEP, np.where(nth > 0, CONTEXT, 0)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of ``x`` less a shift of each row (along the last axis), the sums of rows, and the shifts: 0 unless a row needs one."""
    ones = np.ones(x.shape[-1], np.float32)
    e = np.exp(x) if x.size and x.max() < 60 else None
    sums = None if e is None else (e.reshape(-1, x.shape[-1]) @ ones).reshape(x.shape[:-1])
    if sums is not None and sums.min() > 1e-20:
        return e, sums, np.zeros_like(sums)
    shift = x.max(-1, initial=-1e9)
    e = np.exp(x - shift[..., None])
    return e, (e.reshape(-1, x.shape[-1]) @ ones).reshape(x.shape[:-1]), shift


class Attention:
    """Parameters and passes of the network: embeddings, one layer of one head, output over classes."""

    NAMES = ("embed", "query", "key", "value", "out", "relative")

    def __init__(self, size: int, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        f = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.embed = f(size, WIDTH)
        self.query, self.key, self.value = f(WIDTH, WIDTH), f(WIDTH, WIDTH), f(WIDTH, WIDTH)
        self.out = np.zeros((WIDTH, CLASSES), np.float32)
        self.relative = np.zeros(WINDOW, np.float32)
        back = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self._back = np.maximum(back, 0)
        self._mask = np.where(back >= 0, 0, -1e9).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        """Take over all parameters from one row, in the order of NAMES."""
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[: old.size].reshape(old.shape).copy())
            flat = flat[old.size :]

    def _pass(self, before: np.ndarray, tables: Tables) -> tuple:
        """Logits of classes, their exponentials with sums and shifts (``_exponentials``), and what gradients need."""
        shape, b = before.shape, before.ravel()
        x = np.take(self.embed, b, 0)
        qkv = (x @ np.hstack([self.query * np.float32(WIDTH**-0.5), self.key, self.value])).reshape(*shape, 3 * WIDTH)
        q, k, v = (qkv[..., n * WIDTH : (n + 1) * WIDTH] for n in range(3))
        a = q @ k.transpose(0, 2, 1)
        a += self.relative[self._back] + self._mask
        a, sums, _ = _exponentials(a)
        a /= sums[..., None]
        h = x + (a @ v).reshape(-1, WIDTH)
        z = h @ self.out
        z += np.take(tables.classes, b, 0)
        return z, *_exponentials(z), (x, q, k, v, a, h)

    def forward(self, before: np.ndarray, tables: Tables) -> tuple:
        """log P(class) at every place of windows of unit numbers (what stands before each place)."""
        z, _, sums, shift, cache = self._pass(before, tables)
        z -= (np.log(sums) + shift)[:, None]
        return z.reshape(*before.shape, CLASSES), cache

    def log_class(self, before: np.ndarray, wanted: np.ndarray, tables: Tables) -> np.ndarray:
        """log P of the ``wanted`` class at every place."""
        z, _, sums, shift, _ = self._pass(before, tables)
        return (z.ravel()[np.arange(wanted.size) * CLASSES + wanted.ravel()] - np.log(sums) - shift).reshape(wanted.shape)

    def gradients(self, before: np.ndarray, wanted: np.ndarray, valid: np.ndarray, tables: Tables) -> tuple[float, dict]:
        z, d, sums, shift, (x, q, k, v, a, h) = self._pass(before, tables)
        n = max(1, int(valid.sum()))
        weight = valid.ravel().astype(np.float32)
        own = np.arange(wanted.size) * CLASSES + wanted.ravel()
        loss = -float((z.ravel()[own] - np.log(sums) - shift) @ weight) / n
        d /= sums[:, None]
        d.ravel()[own] -= 1
        d *= (weight / np.float32(n))[:, None]
        g = {"out": h.T @ d}
        flat = d @ self.out.T
        dh = flat.reshape(*before.shape, WIDTH)
        da = dh @ v.transpose(0, 2, 1)
        ds = a * (da - ((da * a).reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*before.shape, 1))
        # q is scaled already, so only its own gradient has the scale to come.
        dq = (ds @ k) * np.float32(WIDTH**-0.5)
        dqkv = np.concatenate([dq, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh], 2).reshape(-1, 3 * WIDTH)
        g["query"], g["key"], g["value"] = np.hsplit(x.T @ dqkv, 3)
        g["relative"] = np.bincount(self._back.ravel(), ds.sum(0).ravel() * (self._mask.ravel() == 0), WINDOW).astype(np.float32)
        dx = flat + dqkv @ np.hstack([self.query, self.key, self.value]).T
        cell = before.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        g["embed"] = np.bincount(cell.ravel(), dx.ravel(), self.embed.size).astype(np.float32).reshape(self.embed.shape)
        return loss, g

    def train(self, before: np.ndarray, wanted: np.ndarray, valid: np.ndarray, tables: Tables, rounds: int = 2, batch: int = 128, span: tuple[float, float] = (0.0, 1.0)) -> list[float]:
        """Adam over windows in a fixed order; returns the mean loss of each round. ``span``: from and to which part of the whole training."""
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        losses, step = [], 0
        steps = rounds * -(-len(before) // batch)
        for r in range(rounds):
            order, total = np.random.Generator(np.random.PCG64(r)).permutation(len(before)), []
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                loss, g = self.gradients(before[at], wanted[at], valid[at], tables)
                total.append(loss)
                step += 1
                rate = 0.02 * (1 - span[0] - (span[1] - span[0]) * step / (steps + 1))
                for n in self.NAMES:
                    first[n] *= 0.9
                    first[n] += 0.1 * g[n]
                    second[n] *= 0.99
                    second[n] += 0.01 * g[n] ** 2
                    change = np.sqrt(second[n] / np.float32(1 - 0.99**step))
                    change += np.float32(1e-7)
                    np.divide(first[n], change, out=change)
                    change *= np.float32(rate / (1 - 0.9**step))
                    setattr(self, n, getattr(self, n) - change)
            losses.append(float(np.mean(total)) if total else 0.0)
        return losses


def windowed(ids: np.ndarray, counts: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit numbers before and at each place of all windows, which places count (each unit once), and their places in ``ids``."""
    number = tables.number[ids]
    firsts = np.cumsum(counts) - counts
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[firsts] = tables.number[END]
    starts, context = cut_windows(counts)
    ends = np.repeat(firsts + counts, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)))
    place = starts[:, None] + np.arange(WINDOW)
    valid = (place < ends[:, None]) & (np.arange(WINDOW) >= context[:, None])
    place = np.minimum(place, len(ids) - 1)
    return before[place], number[place], valid, place


def score_words(texts: list[str | None], vocabulary: Vocabulary, model: Attention, tables: Tables, rows: int = 192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P of each word after what stands before it, log P of each text's end, and the number of words of each text."""
    found = [_score_piece(texts[p], vocabulary, model, tables, rows) for p in pieces(texts)]
    return tuple(np.concatenate([f[k] for f in found] or [np.empty(0, t)]) for k, t in enumerate((np.float64, np.float64, np.int64)))


def _score_piece(texts: list[str | None], vocabulary: Vocabulary, model: Attention, tables: Tables, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, counts, words, size = _units(texts, vocabulary)
    out = np.zeros(len(ids), np.float64)
    before, number, valid, place = windowed(ids, counts, tables)
    for s in range(0, len(before), rows):
        b, u, ok = before[s : s + rows], number[s : s + rows], valid[s : s + rows]
        log_p = model.log_class(b, tables.of_class[u], tables) + tables.within[b, u]
        out[place[s : s + rows][ok]] = log_p[ok]
    out += tables.rare[ids]
    # Each text before a word has one end.
    stop = np.cumsum(size) + np.repeat(np.arange(len(texts)), words.counts)
    upto = np.concatenate([[0.0], np.cumsum(out)])
    return upto[stop] - upto[stop - size], out[np.cumsum(counts) - 1], words.counts
