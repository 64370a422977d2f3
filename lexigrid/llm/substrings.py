"""Exact substring deduplication with fixed-block anchors.

Reference blocks of 7 words, one after another without overlap, are the index; every run of 7 words of
every text probes it. A window of 13 words always holds a whole block, so texts that share a window share
an anchor hit. Around hits the runs are extended: all windows of 13 words that a hit allows are compared
in full, and windows that follow each other make up the maximal repeats, which are cut.

Entries travel in packed rows of many. Before they leave a task, hits that its own texts decide are
settled there, so that a passage which very many texts share sends few entries from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise, release, shuffle_partitions, size_of_texts, small_arrow_batches, text_or_empty
from .words import SPACED, Words, mix, split_words, windows

WINDOW = 13
#: The longest block of which any window holds a whole one.
ANCHOR = (WINDOW + 1) // 2
_LAST = np.iinfo(np.int64).max
#: Bytes of a window's first and second hash that travel (its range says more of the first one), and bytes of text for one range of keys or texts.
KEY_BYTES, MORE_BYTES, RANGE_BYTES = 6, 5, 8 << 20
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _planes(a: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of whole numbers, byte by byte, so that equal high bytes stand together."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)[:, :size].T.tobytes()


def _from_planes(data: bytes, size: int, dtype: type) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((parts.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :size] = parts.T
    return out.reshape(-1).view(dtype)


@dataclass
class Entries:
    """Places in texts: rank and tag name the text, ``key`` and ``more`` are what stands there (or nothing, once it is decided)."""

    rank: np.ndarray
    tag: np.ndarray
    pos: np.ndarray
    key: np.ndarray
    more: np.ndarray | None = None

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.rank[at], self.tag[at], self.pos[at], self.key[at], None if self.more is None else self.more[at])

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        if not parts:
            return Entries(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint64))
        more = None if parts[0].more is None else np.concatenate([p.more for p in parts])
        return Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("rank", "tag", "pos", "key")), more)

    def pack(self, key_bytes: int) -> dict[str, bytes]:
        """Runs of one text once each, then places and keys."""
        new = np.ones(len(self.rank), bool)
        new[1:] = (self.rank[1:] != self.rank[:-1]) | (self.tag[1:] != self.tag[:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(self.rank))).astype(np.uint32)
        return {
            "ranks": _planes(self.rank[starts], 8), "tags": _planes(self.tag[starts], 4), "runs": _planes(runs, 4),
            "places": _planes(self.pos, 4), "keys": _planes(self.key, key_bytes) + (b"" if self.more is None else _planes(self.more, MORE_BYTES)) if key_bytes else b"",
        }

    @staticmethod
    def unpack(row, key_bytes: int) -> Entries:
        runs = _from_planes(row.runs, 4, np.uint32)
        rank, tag = np.repeat(_from_planes(row.ranks, 8, np.int64), runs), np.repeat(_from_planes(row.tags, 4, np.uint32), runs)
        pos = _from_planes(row.places, 4, np.uint32)
        if not key_bytes:
            return Entries(rank, tag, pos, np.zeros(len(pos), np.uint64))
        size, rest = key_bytes * len(pos), row.keys[key_bytes * len(pos) :]
        return Entries(rank, tag, pos, _from_planes(row.keys[:size], key_bytes, np.uint64), _from_planes(rest, MORE_BYTES, np.uint64) if rest else None)


PACKED = "ranks binary, tags binary, runs binary, places binary, keys binary"
_ROW = ("ranks", "tags", "runs", "places", "keys")


def home(rank: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a text; ``_home_column`` is the same for Spark."""
    return (rank ^ (rank >> 7) ^ (rank >> 13) ^ tag.astype(np.int64)) % n


def _home_column(rank, tag, n: int):
    return F.pmod(rank.bitwiseXOR(F.shiftright(rank, 7)).bitwiseXOR(F.shiftright(rank, 13)).bitwiseXOR(tag), F.lit(n)).cast("int")


def _grouped(e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each key begins in it, and the group of each place in it."""
    order = np.argsort(e.key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(e.key[order]) != 0
    if e.more is not None:
        differ = np.diff(e.more[order]) != 0
        if (differ & ~new[1:]).any():  # one key of several windows, which is very rare
            order = np.lexsort((e.more, e.key))
            new[1:] = (np.diff(e.key[order]) != 0) | (np.diff(e.more[order]) != 0)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def anchor_hits(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are hit: probes that meet an anchor of a smaller text, anchors that a larger text's probe
    meets; and which of them others still need: probes not met so far and each key's largest text."""
    if not len(e.key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, starts, group = _grouped(e)
    rank, anchor = e.rank[order], e.pos[order] % ANCHOR == 0
    least = np.minimum.reduceat(np.where(anchor, rank, _LAST), starts)[group]
    most = np.maximum.reduceat(rank, starts)[group]
    met = rank > least
    hit, needed = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    hit[order] = met | (anchor & (rank < most))
    # One entry of the largest text of a key is enough.
    tops = np.flatnonzero(rank == most)
    first_top = np.zeros(len(rank), bool)
    first_top[tops[np.unique(group[tops], return_index=True)[1]]] = True
    needed[order] = ~met | first_top
    return hit, needed


def window_repeats(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Which windows also start in a smaller text, and which ones a text elsewhere may still precede."""
    if not len(e.key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, starts, group = _grouped(e)
    rank = e.rank[order]
    repeated = np.zeros(len(rank), bool)
    repeated[order] = rank > np.minimum.reduceat(rank, starts)[group]
    return repeated, ~repeated


def _rows(e: Entries, to: np.ndarray, key_bytes: int, **fixed) -> list[dict]:
    """A packed row for each value of ``to``."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    return [{**fixed, "p": int(to[part[0]]), **e.take(part).pack(key_bytes)} for part in np.split(order, cuts) if len(part)]


def _settle(rows: pd.DataFrame, decide, key_bytes: int, parts: int) -> pd.DataFrame:
    """Decide the entries of one key range together with what tasks had settled before; packed by home."""
    asked, settled = [], []
    for r in rows.itertuples(index=False):
        (settled if r.settled else asked).append(Entries.unpack(r, 0 if r.settled else key_bytes))
    e = Entries.join(asked)
    hit = e.take(np.flatnonzero(decide(e)[0]))
    done = Entries.join([replace(hit, more=None), *settled])
    return pd.DataFrame(_rows(done, home(done.rank, done.tag, parts), 0), columns=["p", *_ROW])


def _ask(e: Entries, decide, key_bytes: int, parts: int) -> pd.DataFrame:
    """What a task sends out: its own decisions, and what others must decide, by range of the key."""
    hit, needed = decide(e)
    ask, own = e.take(np.flatnonzero(needed)), e.take(np.flatnonzero(hit))
    rows = _rows(ask, ((ask.key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64), key_bytes, settled=False)
    rows += _rows(own, home(own.rank, own.tag, parts), 0, settled=True)
    return pd.DataFrame(rows, columns=["settled", "p", *_ROW])


def _own_places(docs: pd.DataFrame, found: pd.DataFrame) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some texts, and the texts' numbers and places that packed rows name."""
    texts = list(docs["body"])
    words = split_words(texts, SPACED, False)
    e = Entries.join([Entries.unpack(r, 0) for r in found.itertuples(index=False)])
    ranks, tags = docs["rank"].to_numpy(np.int64), docs["tag"].to_numpy(np.int64)
    order = np.lexsort((tags, ranks))
    name = np.rec.fromarrays([ranks[order], tags[order]], names="r,t")
    asked = np.rec.fromarrays([e.rank, e.tag.astype(np.int64)], names="r,t")
    lo, hi = np.searchsorted(name, asked, "left"), np.searchsorted(name, asked, "right")
    # Repeated rows are several texts of one name.
    times = hi - lo
    row = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    text, pos = order[row], np.repeat(e.pos, times).astype(np.int64)
    inside = pos < words.counts[text]
    return words, text[inside], pos[inside]


def _covered(words: Words, text: np.ndarray, pos: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Places from ``pos`` - back to ``pos`` + ahead - 1, as one flag a word, kept inside each text."""
    firsts = words.firsts
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, np.maximum(firsts[text] + pos - back, firsts[text]), 1)
    np.add.at(change, np.minimum(firsts[text] + pos + ahead, firsts[text + 1]), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row.

    A word goes if a window of 13 words over it also starts in a row of smaller doc_id (a whole number).
    Null and empty texts have no words; texts below 13 words keep all. A null doc_id is larger than all
    others; rows of equal doc_id don't take words from each other. Windows are compared by 88 bits of
    hashes of all their words. Keys and texts are dealt to ranges, one for ``range_bytes`` of text or so.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be a whole number, which its order is taken from")
    small_arrow_batches(spark, 2000, "16m")
    parts = max(shuffle_partitions(spark), -(-size_of_texts(df, text) // range_bytes))
    kind = df.schema[doc_id].dataType.simpleString()
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST)))
    body = text_or_empty(text)
    docs = df.select(rank.alias("rank"), F.crc32(body.cast("binary")).alias("tag"), body.alias("body"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = split_words(list(pdf["body"]), SPACED, False)
            key, ok = windows(words, ANCHOR)
            ok &= np.repeat(words.counts >= WINDOW, words.counts)
            at = np.flatnonzero(ok)
            owner = np.repeat(np.arange(len(pdf)), words.counts)[at]
            e = Entries(pdf["rank"].to_numpy(np.int64)[owner], pdf["tag"].to_numpy(np.uint32)[owner], (at - words.firsts[owner]).astype(np.uint32), key[at])
            yield _ask(e, anchor_hits, 5, parts)

    # Five bytes of a key travel; the range that a row belongs to is the rest of it.
    asked = docs.mapInPandas(probe, f"settled boolean, p int, {PACKED}")
    hits = materialise(asked.repartition(parts, "p").groupBy("p").applyInPandas(lambda rows: _settle(rows, anchor_hits, 5, parts), f"p int, {PACKED}"), "anchor-hits")
    del asked
    release(spark)

    placed = docs.withColumn("p", _home_column(F.col("rank"), F.col("tag"), parts))

    def extend(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["settled", "p", *_ROW, "rank", "tag", "body", "n_words"]
        if docs.empty:
            return pd.DataFrame(columns=columns)
        words, text, pos = _own_places(docs, found)
        key, ok = windows(words, WINDOW)
        ok &= _covered(words, text, pos, ANCHOR - 1, 1)
        at = np.flatnonzero(ok)
        owner = np.repeat(np.arange(len(docs)), words.counts)[at]
        ranks, tags = docs["rank"].to_numpy(np.int64), docs["tag"].to_numpy(np.uint32)
        second = windows(replace(words, hashes=mix(words.hashes ^ _SECOND)), WINDOW)[0][at] & np.uint64((1 << 8 * MORE_BYTES) - 1)
        e = Entries(ranks[owner], tags[owner], (at - words.firsts[owner]).astype(np.uint32), key[at], second)
        # Repeated rows of one name would ask twice.
        out = _ask(e, window_repeats, KEY_BYTES, parts)
        open_ = np.zeros(len(docs), bool)
        open_[owner] = True
        rest = pd.DataFrame({"p": docs["p"], "rank": ranks, "tag": docs["tag"], "n_words": words.counts.astype(np.int64)})
        rest["body"] = docs["body"].where(open_, None)
        # Texts without candidates are done: all their words stay.
        rest["keys"] = [None if o else hashlib.sha256(b" ".join(words.data[s:e] for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True))).digest()
                        for o, a, b in zip(open_, words.firsts, words.firsts[1:], strict=False)]
        for name in ("rank", "tag", "n_words"):  # whole numbers on both sides, or concat makes floats of them
            out[name] = pd.array([pd.NA] * len(out), dtype="Int64")
            rest[name] = rest[name].astype("Int64")
        out["body"], rest["settled"] = None, None
        return pd.concat([out, rest], ignore_index=True).reindex(columns=columns)

    mixed = f"settled boolean, p int, {PACKED}, rank long, tag long, body string, n_words long"
    extended = materialise(placed.repartition(parts, "p").groupBy("p").cogroup(hits.repartition(parts, "p").groupBy("p")).applyInPandas(extend, mixed), "extended")
    release(spark)
    candidates = extended.filter("settled is not null").select("settled", "p", *_ROW)
    repeats = candidates.repartition(parts, "p").groupBy("p").applyInPandas(lambda rows: _settle(rows, window_repeats, KEY_BYTES, parts), f"p int, {PACKED}")

    def cut(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["rank", "n_words", "n_removed", "kept_sha256", "kept"]
        if docs.empty:
            return pd.DataFrame(columns=columns)
        words, text, pos = _own_places(docs, found)
        gone = _covered(words, text, pos, 0, WINDOW)
        firsts, kept, removed = words.firsts, [], []
        for a, b in zip(firsts, firsts[1:], strict=False):
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join(words.data[s:e] for s, e in zip(words.starts[stay], words.ends[stay], strict=True)))
            removed.append(int(b - a - len(stay)))
        return pd.DataFrame({
            "rank": docs["rank"], "n_words": words.counts.astype(np.int64), "n_removed": removed,
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": [k.decode() for k in kept],
        })

    open_ = extended.filter("settled is null and body is not null").select("p", "rank", "tag", "body")
    done = open_.repartition(parts, "p").groupBy("p").cogroup(repeats.repartition(parts, "p").groupBy("p")).applyInPandas(cut, "rank long, n_words long, n_removed long, kept_sha256 string, kept string")
    whole = extended.filter("settled is null and body is null").select("rank", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("keys")).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    own = F.when(F.col("rank") == int(_LAST), F.lit(None)).otherwise(F.col("rank")).cast(kind).alias(doc_id)
    # ``kept`` is null where all words stay, which needs no copy of the text.
    return done.unionByName(whole).select(own, "n_words", "n_removed", "kept_sha256", "kept")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` without the windows that a row of smaller doc_id has too; null texts have no words, repeated rows keep theirs."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op6_substrings": op6_substrings}
ORACLES = {
    "op6_substrings": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS k FROM d)
), first AS (SELECT g, min(doc_id) AS least FROM wins GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS i FROM wins JOIN first USING (g) WHERE least < doc_id),
lost AS (SELECT doc_id, count(*) AS n, list(i) AS places FROM gone GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
