"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Training words stream through the automaton, which gives the longest stretch of item words that ends at
each of them; where it reaches a window's length, the window's words are hit. Stretches in which no pair
of neighbours occurs in any item cannot reach that length and are passed over by array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import documents, materialise, small_arrow_batches, text_or_empty, unused_names
from .words import ALNUM, split_words

WINDOW = 10
#: Bytes of items that one automaton takes. More items go through the documents one such part after another.
ITEM_BYTES = 8 << 20


class Items:
    """The automaton of one part of the items, with what is known of them at each of its states."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        words = split_words([t for _, t in items], ALNUM, True)
        self.names = [str(i) for i, _ in items]
        firsts = words.firsts
        self.word_ids: dict[bytes, int] = {}
        sequences, hashes = [], {}
        for k in range(len(items)):
            ids = []
            for w in range(firsts[k], firsts[k + 1]):
                i = self.word_ids.setdefault(words.text_of(w), len(self.word_ids) + 1)
                hashes[i] = words.hashes[w]
                ids.append(i)
            sequences.append(ids)
        self.radix = len(self.word_ids) + 1
        self.automaton = a = SuffixAutomaton(self.radix)
        for ids in sequences:
            a.add(ids)
        #: Items by the state of their windows, and short items whole: [(length, item)].
        self.windows: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        pairs, self.least = set(), window
        for item, ids in enumerate(sequences):
            pairs.update(zip(ids, ids[1:], strict=False))
            if 0 < len(ids) < window:
                self.least = min(self.least, len(ids))
                self.short.setdefault(a.find(ids), []).append((len(ids), item))
            for s in {a.find(ids[k : k + window]) for k in range(len(ids) - window + 1)}:
                self.windows.setdefault(s, []).append(item)
        # Words by hash, and pairs of them, as sorted arrays behind small tables of bits.
        order = np.argsort(np.array([hashes[i] for i in range(1, self.radix)], np.uint64))
        self.sorted_hashes = np.array([hashes[i] for i in range(1, self.radix)], np.uint64)[order]
        self.sorted_ids = (order + 1).astype(np.int64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.sorted_hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.pairs = np.sort(np.fromiter((x * self.radix + y for x, y in pairs), np.int64, len(pairs)))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.table[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.sorted_hashes):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.sorted_hashes, h), len(self.sorted_hashes) - 1)
            same = self.sorted_hashes[at] == h
            out[maybe[same]] = self.sorted_ids[at[same]]
        return out

    def stretches(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, start and end, in which every pair of neighbours is one of some item, long enough to matter."""
        n = len(ids)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        bound = np.zeros(n, bool)  # to the word before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            code = ids[both - 1] * self.radix + ids[both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            bound[both[self.pairs[at] == code]] = True
        firsts = np.cumsum(counts)[:-1]
        bound[firsts[firsts < n]] = False
        begins = known & ~bound
        ends = known & ~np.append(bound[1:], False)
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        keep = e - s >= self.least
        return s[keep], e[keep]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit intervals of words and the items whose windows occur, by one walk through the automaton."""
        a, state, matched = self.automaton, 0, 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for k, w in enumerate(words, 1):
            number = self.word_ids.get(w)
            state, matched = a.step(state, matched, number) if number else (0, 0)
            up, longest = state, 0
            while up > 0:
                limit = min(matched, a.length[up])
                if limit >= self.window and a.length[a.link[up]] < self.window:
                    found = self.windows.get(up)
                    if found:
                        items.update(found)
                        longest = max(longest, self.window)
                for n, item in self.short.get(up, ()):
                    if n <= limit:
                        items.add(item)
                        longest = max(longest, n)
                up = a.link[up]
            if longest:
                hits.append((k - longest, k))
        return hits, items


def _mark(df: DataFrame, items: Items, text: str, cols: tuple[str, str, str]) -> DataFrame:
    """Add to the running columns (number of words, hit intervals as packed numbers, items)."""
    shared = df.sparkSession.sparkContext.broadcast(items)
    n_col, hit_col, item_col = cols

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = shared.value
        for pdf in batches:
            words = split_words(list(pdf[text]), ALNUM, True)
            starts, ends = part.stretches(part.number(words.hashes), words.counts)
            firsts = words.firsts
            docs = np.searchsorted(firsts, starts, "right") - 1
            hit = [list(x) for x in pdf[hit_col]]
            named = [list(x) for x in pdf[item_col]]
            for s, e, d in zip(starts.tolist(), ends.tolist(), docs.tolist(), strict=True):
                found, items = part.match([words.text_of(w) for w in range(s, e)])
                for a, b in found:
                    hit[d] += [s - int(firsts[d]) + a, s - int(firsts[d]) + b]
                named[d] += [part.names[i] for i in items]
            out = pdf.copy(deep=False)
            out[n_col] = words.counts.astype(np.int64)
            out[hit_col] = [np.array(h, np.int64) for h in hit]
            out[item_col] = [sorted(set(x)) for x in named]
            yield out

    return df.mapInPandas(run, df.schema)


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       item_bytes: int = ITEM_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """``df`` with three more columns, whose names come back too: the number of words, the hit word intervals
    (start, end, start, end ...; they may overlap) and the sorted item ids whose windows occur.

    Words are runs of letters and digits with A-Z lower-cased; a window is ``window`` words of an item, or
    the whole of a shorter one. Null and empty texts have no words, such items no windows; items with one id
    count once; an item of null id is called ``None``. Items reach the executors ``item_bytes`` at a time,
    however many there are; texts are handled on their own, whatever their length or repetition.
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    names = unused_names(df, "n_words", "hits", "items")
    marked = df.withColumn(names[0], F.lit(0).cast("long")).withColumn(names[1], F.array().cast("array<bigint>")).withColumn(names[2], F.array().cast("array<string>"))
    body = items.select(F.col(item_id).cast("string").alias("id"), text_or_empty(item_text).alias("body"))
    total = body.agg(F.sum(F.octet_length("body") + 1)).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    for k in range(parts):
        part = body if parts == 1 else body.filter(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == k)
        # One part of the items, item_bytes or little more of text, is what the driver holds.
        held = Items([(r.id, r.body) for r in part.toLocalIterator()], window)
        marked = _mark(marked, held, text, tuple(names))
        if parts > 1:
            marked = materialise(marked, "decontamination")
    return marked, tuple(names)


def covered(intervals: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals given as start, end, start, end ..., sorted."""
    out: list[list[int]] = []
    for s, e in sorted(zip(intervals[0::2], intervals[1::2], strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(e))
        else:
            out.append([int(s), int(e)])
    return [(s, e) for s, e in out]


def hit_count(df: DataFrame, hits: str, to: str) -> DataFrame:
    """How many words the intervals of ``hits`` cover, as column ``to``."""

    @F.pandas_udf("long")
    def count(x: pd.Series) -> pd.Series:
        return x.map(lambda v: sum(e - s for s, e in covered(v)))

    return df.withColumn(to, count(F.col(hits)))


def remove_contamination(df: DataFrame, items: DataFrame, text: str = "text", most: float = 0.5, least_words: int = 1, **options) -> DataFrame:
    """``df`` with the spans of item windows cut out of ``text``.

    Rows in which more than ``most`` of all words are hit go as a whole. Hit words go with what stands
    between them; the rest of the text stays as it was. Rows without hits are unchanged, null texts too.
    """
    marked, (n_words, hits, named) = find_contamination(df, items, text, **options)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, texts = [], []
            for t, n, h in zip(pdf[text], pdf[n_words], pdf[hits], strict=True):
                spans = covered(h)
                if not spans or sum(e - s for s, e in spans) < least_words:
                    keep.append(True)
                    texts.append(t)
                    continue
                keep.append(sum(e - s for s, e in spans) <= most * n)
                words, data = split_words([t], ALNUM, False), t.encode()
                pieces, at = [], 0
                for s, e in spans:
                    pieces.append(data[at : words.starts[s]])
                    at = int(words.ends[e - 1])
                texts.append(b"".join([*pieces, data[at:]]).decode())
            out = pdf[[c for c in pdf.columns if c not in (n_words, hits, named)]].copy()
            out[text] = texts
            yield out[keep]

    return marked.mapInPandas(cut, df.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every row of ``documents``; null texts have no words, repeated rows are rows like others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked, (n_words, hits, named) = find_contamination(docs, items)
    found = hit_count(marked, hits, "n_hit")
    return found.select(
        "doc_id", n_words, "n_hit", F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {
    "op2_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, lens)
), hits AS (SELECT doc_id, n, k, item_id FROM grams JOIN wins USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
}
