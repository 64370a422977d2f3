"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases: each phrase is the shortest piece that is not
in the text's dictionary yet, and joins it. The smallest hashes of the phrases are the fingerprint; the
share of common ones among the smallest of two fingerprints estimates how much of one text's dictionary
the other has, as a compressor would find.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, shuffle_partitions, small_arrow_batches, text_or_empty
from .words import mix

#: Hashes of a fingerprint.
SIZE = 64


def parse(text: str, seen: set[str], open_: str = "") -> str:
    """Add the phrases of ``text`` to ``seen``; ``open_`` is the unfinished phrase before it, and what is returned the one behind."""
    for letter in text:
        open_ += letter
        if open_ not in seen:
            seen.add(open_)
            open_ = ""
    return open_


def smallest(phrases: set[str], size: int = SIZE) -> list[int]:
    """The smallest hashes (32 bits) of the phrases, in order."""
    crc = np.fromiter((zlib.crc32(p.encode()) for p in phrases), np.uint64, len(phrases))
    h = np.unique((mix(crc + np.uint64(1)) >> np.uint64(32)).astype(np.uint32))
    return h[:size].tolist()


def fingerprint(text: str, size: int = SIZE) -> list[int]:
    seen: set[str] = set()
    parse(text, seen)
    return smallest(seen, size)


def likeness(a: list[int], b: list[int], size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets; 1 for two empty ones."""
    x, y = set(a), set(b)
    union = sorted(x | y)[:size]
    return sum(h in x and h in y for h in union) / len(union) if union else 1.0


def written(hashes: list[int]) -> str:
    return "".join([f"{h:08x}" for h in hashes])


def analyse(text: str, following: str) -> tuple[int, str, list[int], list[int]]:
    """Length, digest of the edited text, and the fingerprints of the text and of the edited one.

    The edited text has the text's first half, so both are parsed from one state at its end.
    """
    n = len(text)
    half, other = text[: n - n // 2], following[: n // 2]
    seen: set[str] = set()
    open_ = parse(half, seen)
    edited = set(seen)
    parse(text[n - n // 2 :], seen, open_)
    parse(other, edited, open_)
    return n, hashlib.sha256((half + other).encode()).hexdigest(), smallest(seen), smallest(edited)


def _result(rank, tail: tuple, next_fingerprint: list[int]) -> tuple:
    n, digest, own, edited = tail
    return rank, n, digest, written(own), written(edited), likeness(own, edited), likeness(own, next_fingerprint)


_OUT = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compare_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half the next row's beginning replaces.

    Rows follow each other by descending doc_id (null last; equal ids by text), the first follows the last.
    Null texts count as empty; an empty text has an empty fingerprint. A single row follows itself. Rows
    are sorted by ranges of doc_id and stream through the tasks one by one; the first and the last row of
    each range meet afterwards.
    """
    spark = df.sparkSession
    small_arrow_batches(spark, 500, "16m")
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("body"))
    order = F.col("id").desc_nulls_last()
    ranged = rows.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order, "body")
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, last boolean, body string"

    def frame(done: list[tuple], edges: list[tuple]) -> pd.DataFrame:
        a = pd.DataFrame(done, columns=_OUT, dtype=object)
        b = pd.DataFrame(edges, columns=["id", "part", "last", "body"], dtype=object)
        return pd.concat([a, b]).reindex(columns=[*_OUT, "part", "last", "body"]).astype(object).where(lambda x: x.notna(), None)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, before, waiting = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            done, edges = [], []
            for rank, body in zip(pdf["id"].astype(object), pdf["body"], strict=True):
                rank = None if pd.isna(rank) else rank
                if before is None:
                    edges.append((rank, part, False, body))
                else:
                    found = analyse(before[1], body)
                    if waiting:
                        done.append(_result(*waiting, found[2]))
                    waiting = before[0], found
                before = rank, body
            yield frame(done, edges)
        if before is not None:
            yield frame([_result(*waiting, fingerprint(before[1]))] if waiting else [], [(before[0], part, True, before[1])])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last row of each range with the first of the next, the very last with the very first."""
        first = last = None

        def one(a: tuple, body: str) -> pd.DataFrame:
            return pd.DataFrame([_result(a[0], analyse(a[1], body), fingerprint(body))], columns=_OUT)

        for pdf in batches:
            for rank, is_last, body in zip(pdf["id"].astype(object), pdf["last"], pdf["body"], strict=True):
                if is_last:
                    last = None if pd.isna(rank) else rank, body
                else:
                    first = body if first is None else first
                    if last is not None:
                        yield one(last, body)
                        last = None
        if last is not None:
            yield one(last, first)

    walked = materialise(ranged.mapInPandas(walk, schema), "fingerprints")
    # Two rows of each range, whatever their number of rows.
    edges = walked.filter("part is not null").select("id", "part", "last", "body").repartition(1).sortWithinPartitions("part", "last")
    met = edges.mapInPandas(meet, schema.partition(", part")[0])
    return walked.filter("part is null").select(*_OUT).unionByName(met).withColumnRenamed("id", doc_id)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and likeness to its edited text and its neighbour; null texts count as empty, ties of doc_id stand in any order."""
    return compare_neighbours(documents(spark, sf_dir))


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
