"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding. The suffix automaton of the
vocabulary gives the tokens that end at a place, longest first; the first one that is compatible with
the last token of the prefix before it is the one. Following the stored tokens back gives the ids.
Two tokens are compatible if no merge would have joined them across their border.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import documents, small_arrow_batches, unused_names
from .tables import Lookup, Remembered

#: The published splitting pattern of byte-level BPE. Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and stretches between spaces after which a worker's memory of them is emptied before its next batch.
MEMORY_ENTRIES = 250_000
#: Bytes of a piece up to which pieces are encoded in step, and places (as a power of 2) for answers of the pair test.
STEP_BYTES, FITS_BITS = 512, 20
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of this kind: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _spines(parts: dict, rank: dict, tokens: list[int], side: int) -> dict[int, list[tuple[int, int]]]:
    """For each token the parts at one edge from its single byte up, each with the merge that ends it."""
    known: dict[int, list[tuple[int, int]]] = {}
    for token in tokens:
        todo = [token]
        while todo[-1] not in known and todo[-1] in parts:
            todo.append(parts[todo[-1]][side])
        for t in reversed(todo):
            if t not in known:
                half = parts[t][side] if t in parts else None
                known[t] = [(t, _NEVER)] if half is None else [*known[half][:-1], (half, rank[parts[t]]), (t, _NEVER)]
    return known


class Vocabulary:
    """What a vocabulary file says, with the automaton of its tokens, as arrays; made once and sent to the workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        words = dict(self.bytes_of)
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left, right) to the place of their merge, and the parts that a token was made of.
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {}
        for a, b in pairs:
            self.parts.setdefault(ids[a + b], (ids[a], ids[b]))
        automaton = SuffixAutomaton(256)
        ends = [(automaton.add(b), i) for i, b in words.items()]
        ends = [(automaton.find(words[i]), i) for _, i in ends]
        if any(b not in automaton.next for b in range(256)):
            raise ValueError("a vocabulary of bytes must have all 256 of them")
        self.wide = max(self.bytes_of) + 1
        spines = [_spines(self.parts, self.rank, list(words), side) for side in (1, 0)]
        #: Spines one after another: where each token's begins, its parts and the merges that end them.
        self.spines = []
        for known in spines:
            first = np.zeros(self.wide + 1, np.int64)
            first[list(known)] = [len(x) for x in known.values()]
            order = sorted(known)
            self.spines.append((np.concatenate([[0], np.cumsum(first)[:-1]]), *np.array([x for t in order for x in known[t]], np.int64).T))
        self.size = np.zeros(self.wide, np.int32)
        self.size[list(words)] = [len(b) for b in words.values()]
        whole: dict[int, bool] = {}
        for i in sorted(words, key=lambda i: len(words[i])):
            halves = self.parts.get(i)
            # A file may hold tokens that no merges reach.
            whole[i] = len(words[i]) == 1 if halves is None else whole[halves[0]] and whole[halves[1]] and _joins(spines[0][halves[0]], spines[1][halves[1]], self.rank, halves)
        own: dict[int, list[int]] = {}
        for state, i in ends:
            if whole[i]:
                own.setdefault(state, []).append(i)
        #: The longest token that ends where the automaton is in a state, and the next shorter one that ends each token.
        self.longest, self.shorter = np.full(len(automaton.link), -1, np.int32), np.full(self.wide, -1, np.int32)
        for state in sorted(range(1, len(automaton.link)), key=automaton.length.__getitem__):
            next_one = self.longest[automaton.link[state]]
            for i in sorted(own.get(state, ()), key=lambda i: len(words[i])):
                self.shorter[i], next_one = next_one, i
            self.longest[state] = next_one
        self.automaton = automaton.packed()
        self._codec: Codec | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codec": None}

    def codec(self, memory: int) -> Codec:
        """The codec of this process. It goes when the vocabulary does, which a worker drops with its broadcast."""
        if self._codec is None or self._codec.memory != memory:
            self._codec = Codec(self, memory)
        return self._codec


def _joins(a: list[tuple[int, int]], b: list[tuple[int, int]], rank: dict, halves: tuple[int, int]) -> bool:
    """Whether the two halves of a token, of these spines, stay whole until their own merge."""
    i = j = 0
    while i < len(a) - 1 or j < len(b) - 1:
        (x, x_ends), (y, y_ends) = a[i], b[j]
        r = rank.get((x, y), _NEVER)
        if r < x_ends and r <= y_ends:
            return False
        i, j = (i + 1, j) if x_ends <= y_ends else (i, j + 1)
    return halves in rank


class Codec:
    """Encoder and decoder of one worker. Pieces that it has not seen yet are encoded many at a time, byte by byte in step."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY_ENTRIES):
        # Not the vocabulary itself: without a cycle both are freed at once.
        v, self.memory = vocabulary, memory
        self.added, self.bytes_of = v.added, v.bytes_of
        self._wide, self._size, self._longest, self._shorter = v.wide, v.size, v.longest, v.shorter
        self._spines, self._arrays = v.spines, v.automaton
        self._follow = Lookup(v.automaton["keys"], v.automaton["to"])
        self._rank = Lookup(np.array([a * v.wide + b for a, b in v.rank], np.int64), np.fromiter(v.rank.values(), np.int32, len(v.rank)))
        self._fits = Remembered(FITS_BITS)
        self._listed = {i: b"%d," % i for i in v.bytes_of}
        self._endless: SuffixAutomaton | None = None
        #: Ids (as text, a comma behind each) and bytes of pieces, and of stretches between spaces with the space before.
        self._pieces: dict[str, tuple[bytes, bytes]] = {}
        self._chunk_ids: dict[str, bytes] = {}
        self._chunk_bytes: dict[str, bytes] = {}
        self._letters = 0
        self._split = regex.compile(PIECES)
        # The same pattern in the faster module, where text has only letters and digits that both see alike.
        self._split_plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self._plain = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u02af\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None

    # -- compatibility ------------------------------------------------------------------------------------------------

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of both tokens' bytes gives just these two, pair by pair."""
        return self._fits.get(left.astype(np.int64) * self._wide + right, lambda at: self._compatible(left[at], right[at]))

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        (a_first, a_part, a_ends), (b_first, b_part, b_ends) = self._spines
        i, j, open_ = a_first[left], b_first[right], np.arange(len(left))
        out = np.zeros(len(left), bool)
        while len(open_):
            x_ends, y_ends = a_ends[i], b_ends[j]
            r = self._rank.get(a_part[i] * self._wide + b_part[j]).astype(np.int64)
            r[r < 0] = _NEVER
            # Of equal merges the one further left comes first.
            joined, apart = (r < x_ends) & (r <= y_ends), (x_ends == _NEVER) & (y_ends == _NEVER)
            out[open_[~joined & apart]] = True
            on = ~(joined | apart)
            up = x_ends <= y_ends
            i, j, open_ = (i + up)[on], (j + ~up)[on], open_[on]
        return out

    # -- encoding -----------------------------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces by the program over their prefixes: one place of all pieces after another."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        flat, start = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(size) - size)[order]
        size = size[order]
        # A piece has a place for each of its prefixes, the empty one too.
        base = np.cumsum(size + 1) - size - 1
        last = np.zeros(len(flat) + len(pieces), np.int32)
        link, length = self._arrays["link"], self._arrays["length"]
        state, matched = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        going = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for p, n in enumerate(going):
            symbol, now = flat[start[:n] + p].astype(np.int64), state[:n]
            to = self._follow.get(now << 8 | symbol)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                now[stuck] = link[now[stuck]]
                matched[stuck] = length[now[stuck]]
                to[stuck] = self._follow.get(now[stuck] << 8 | symbol[stuck])
                stuck = stuck[to[stuck] < 0]
            state[:n] = to
            matched[:n] += 1
            token, open_ = self._longest[to], np.arange(n)
            while len(open_):
                t = token[open_]
                long = self._size[t]
                good = long <= matched[open_]
                after = np.flatnonzero(good & (long <= p))
                good[after] = self.fits(last[base[open_[after]] + p + 1 - long[after]], t[after])
                last[base[open_[good]] + p + 1] = t[good]
                open_ = open_[~good]
                token[open_] = self._shorter[token[open_]]
        # Back along the stored tokens.
        found, at, open_ = [], size.copy(), np.flatnonzero(size)
        while len(open_):
            t = last[base[open_] + at[open_]]
            found.append((open_, t))
            at[open_] -= self._size[t]
            open_ = open_[at[open_] > 0]
        times = np.zeros(len(pieces), np.int64)
        for who, _ in found:
            times[who] += 1
        stops = np.cumsum(times)
        ids, at = np.zeros(int(times.sum()), np.int32), stops.copy()
        for who, t in found:
            at[who] -= 1
            ids[at[who]] = t
        listed, out = ids.tolist(), [[]] * len(pieces)
        for k, a, b in zip(order.tolist(), (stops - times).tolist(), stops.tolist(), strict=True):
            out[k] = listed[a:b]
        return out

    def encode_endless(self, data: bytes) -> list[int]:
        """The same for one piece that has hardly any others as long beside it."""
        if self._endless is None:
            self._endless = SuffixAutomaton.unpacked(self._arrays)
        automaton, known = self._endless, {}
        last, state, matched = np.zeros(len(data) + 1, np.int32), 0, 0
        for end, symbol in enumerate(data, 1):
            state, matched = automaton.step(state, matched, symbol)
            token = int(self._longest[state])
            while True:
                n = int(self._size[token])
                if n <= matched:
                    if n == end:
                        break
                    pair = int(last[end - n]), token
                    if pair not in known:
                        known[pair] = bool(self.fits(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair]:
                        break
                token = int(self._shorter[token])
            last[end] = token
        ids, at = [], len(data)
        while at:
            ids.append(int(last[at]))
            at -= int(self._size[last[at]])
        return ids[::-1]

    def _learn_pieces(self, wanted: dict[str, None]) -> dict[str, tuple[bytes, bytes]]:
        """Ids as text and bytes of those pieces of ``wanted`` that are not remembered, encoded together."""
        new = [p for p in wanted if p not in self._pieces]
        data = [p.encode() for p in new]
        short = [k for k, d in enumerate(data) if len(d) <= STEP_BYTES]
        encoded: dict[int, list[int]] = dict(zip(short, self.encode_pieces([data[k] for k in short]), strict=True))
        listed, bytes_of, out = self._listed.__getitem__, self.bytes_of.__getitem__, {}
        for k, p in enumerate(new):
            ids = encoded[k] if k in encoded else self.encode_endless(data[k])
            out[p] = b"".join(map(listed, ids)), b"".join(map(bytes_of, ids))
        return out

    def pieces(self, text: str) -> list[str]:
        split = self._split_plain if self._plain.fullmatch(text) else self._split
        return split.findall(text)

    def _cut(self, text: str, fresh: dict[str, list[str]]) -> tuple[list[str], list[str]]:
        """Pieces and then chunks (each after a space) of text without added tokens; new chunks go to ``fresh``.

        Between single spaces, what stands before a space doesn't matter; with white space at the edge of a
        chunk the splits depend on what is around, and there are only pieces.
        """
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            known = self._chunk_ids
            new = [c for c in set(rest) if c not in known and c not in fresh]
            if "" not in new and not any([c[0].isspace() or c[-1].isspace() for c in new]):
                for c in new:
                    fresh[c] = [" " + c] if c.isascii() and c.isalpha() else self.pieces(" " + c)
                return self.pieces(first), rest
        return self.pieces(text), []

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of whole texts, comma behind each, and the bytes that they decode to."""
        # Letters count too, by the length of a usual piece.
        if max(len(self._chunk_ids) + len(self._pieces), self._letters // 16) > self.memory:
            self._pieces, self._chunk_ids, self._chunk_bytes, self._letters = {}, {}, {}, 0
        fresh: dict[str, list[str]] = {}
        cut: list[list[tuple[list[str], list[str]] | int]] = []
        for text in texts:
            runs = self._added.split(text) if self._added and self._added.search(text) else [text]
            cut.append([self.added[r] if i % 2 else self._cut(r, fresh) for i, r in enumerate(runs) if r])
        several = [found for found in fresh.values() if len(found) != 1] + [x[0] for parts in cut for x in parts if not isinstance(x, int)]
        wanted: dict[str, None] = {found[0]: None for found in fresh.values() if len(found) == 1}
        for found in several:
            for p in found:
                wanted[p] = None
        learnt = self._learn_pieces(wanted)
        for c, found in fresh.items():
            if len(found) == 1:
                # Remembered as the chunk that it is.
                self._chunk_ids[c], self._chunk_bytes[c] = learnt.get(found[0]) or self._pieces[found[0]]
        for found in several:
            for p in found:
                if p in learnt:
                    self._pieces[p] = learnt[p]
                    self._letters += len(p)
        known = self._pieces
        for c, found in fresh.items():
            if len(found) != 1:
                self._chunk_ids[c] = b"".join([known[p][0] for p in found])
                self._chunk_bytes[c] = b"".join([known[p][1] for p in found])
            self._letters += len(c)
        ids_of, bytes_of, out = self._chunk_ids.__getitem__, self._chunk_bytes.__getitem__, []
        for parts in cut:
            ids, data = [], []
            for x in parts:
                if isinstance(x, int):
                    ids.append(self._listed[x])
                    data.append(self.bytes_of[x])
                else:
                    ids += [known[p][0] for p in x[0]]
                    data += [known[p][1] for p in x[0]]
                    ids += map(ids_of, x[1])
                    data += map(bytes_of, x[1])
            out.append((b"".join(ids), b"".join(data)))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text])[0][0].split(b",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False, with_text: bool = False,
                     memory: int = MEMORY_ENTRIES) -> DataFrame:
    """Encode every text and decode the ids again.

    Adds n_tokens, ids_sha256, decoded_sha256 and, as asked, ``ids`` (array) and ``decoded`` to the columns
    of ``df``; a name that is taken gets an underscore behind it. Null texts count as empty: no tokens, the
    digests of the empty string. Texts are encoded on their own, so repeated rows, ties and any length are
    alike; a text of one endless word needs memory in proportion. The vocabulary has a fixed size and is
    broadcast. A worker remembers about ``memory`` pieces; with fewer it is slower and smaller.
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_vocabulary()))
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_text else {})
    names = unused_names(df, *kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.value.codec(memory)
        for pdf in batches:
            rows = []
            for ids, data in codec.encode_texts([t if isinstance(t, str) else "" for t in pdf[text]]):
                try:
                    data.decode()
                except UnicodeDecodeError:
                    data = data.decode("utf-8", "replace").encode()
                listed = ids[:-1]
                row = [ids.count(b","), hashlib.sha256(listed).hexdigest(), hashlib.sha256(data).hexdigest()]
                if with_ids:
                    row.append(np.array(listed.split(b",") if listed else [], dtype=np.int32))
                if with_text:
                    row.append(data.decode())
                rows.append(row)
            out = pdf.copy(deep=False)
            for k, name in enumerate(names):
                out[name] = [r[k] for r in rows]
            yield out

    wide = df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in zip(names, kinds.values(), strict=True)))
    return df.mapInPandas(run, wide.schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of ``documents``; null texts count as empty, repeated rows stay."""
    found = encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
