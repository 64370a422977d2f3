"""How near the occurrences of different tracks are: company, and destinations worth reading."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bins import track_names
from .corpus import Corpus

#: Lower edges of the gap buckets. Fixed values.
GAP_EDGES = (0, 1, 2, 3, 4, 5, 7, 10, 15, 25, 50, 100, 200)
NEARBY = 25
WINDOW, RESULTS, PER_DOC = 400, 12, 8
_SCALE, _COUNT_CAP, _MOST_WEIGHT = 65_536, 4_096, 16 * 65_536


def nearest(occ: DataFrame, tracks: int, most_tracks: int = 5) -> DataFrame:
    """For each occurrence and each other track of ``tracks``: the gap to its nearest occurrence in the document and the direction.

    A document's occurrences are sorted once. What lies before is known by the largest end of all smaller
    starts, which need not be the last one's.
    """
    if not 2 <= tracks <= most_tracks:
        raise ValueError(f"2 to {most_tracks} tracks")
    end = F.col("pos") + F.col("span")
    before = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    # Backwards, as a frame without an end is read again for each row.
    after = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = [F.struct(F.lit(p).alias("peer"), F.max(F.when(F.col("track") == p, end)).over(before).alias("prior"), F.min(F.when(F.col("track") == p, F.col("pos"))).over(after).alias("next")) for p in range(tracks)]
    rows = occ.withColumn("peers", F.array(*peers)).select("track", "doc_id", "pos", end.alias("end"), F.explode("peers").alias("p")).select("track", "doc_id", "pos", "end", "p.*").filter("track <> peer")
    overlap = F.coalesce(F.col("prior") > F.col("pos"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    back, ahead = F.col("pos") - F.col("prior"), F.col("next") - F.col("end")
    gap = F.when(overlap, 0).otherwise(F.least(back, ahead))
    way = F.when(overlap, "overlap").when(gap.isNull(), "none").when(F.coalesce(back == ahead, F.lit(False)), "tied").when(ahead.isNull() | (back < ahead), "backward").otherwise("forward")
    return rows.select("track", "peer", "doc_id", "pos", gap.alias("gap"), way.alias("way"))


_WAYS = ("forward", "backward", "tied", "overlap", "none")


def company(occ: DataFrame, tracks: int) -> DataFrame:
    """Per ordered pair of tracks and gap bucket (null: no peer in the document), the number of occurrences by direction.

    A track that occurs nowhere has no rows of its own; others count it as ``none``.
    """
    edge = F.lit(None).cast("int")
    for e in GAP_EDGES:
        edge = F.when(F.col("gap") >= e, F.lit(e)).otherwise(edge)
    rows = nearest(occ, tracks).withColumn("bucket_edge", edge)
    counts = [F.count_if(F.col("way") == w).alias(w) for w in _WAYS]
    return rows.groupBy("track", "peer", "bucket_edge").agg(F.count("*").alias("n"), *counts)


def _pairs(occ: DataFrame, tracks: int) -> DataFrame:
    return occ.sparkSession.createDataFrame([(a, b) for a in range(tracks) for b in range(a + 1, tracks)], "track int, peer int")


def docs_with_both(occ: DataFrame, tracks: int) -> DataFrame:
    """Per pair of tracks (track < peer), the number of documents that have both."""
    docs = occ.select("track", "doc_id").distinct()
    both = docs.join(docs.withColumnRenamed("track", "peer"), "doc_id").filter("track < peer").groupBy("track", "peer").agg(F.count("*").alias("docs_with_both"))
    return _pairs(occ, tracks).join(both, ["track", "peer"], "left").fillna(0, ["docs_with_both"])


def company_pairs(occ: DataFrame, tracks: int) -> DataFrame:
    """Every pair of tracks (track < peer) with docs_with_both and the directions of both ways: forward, backward,
    tied, overlap and none of the track's occurrences, and the same with ``_back`` of the peer's."""
    sums = company(occ, tracks).groupBy("track", "peer").agg(*[F.sum(w).alias(w) for w in _WAYS])
    back = sums.select(F.col("peer").alias("track"), F.col("track").alias("peer"), *[F.col(w).alias(f"{w}_back") for w in _WAYS])
    return docs_with_both(occ, tracks).join(sums, ["track", "peer"], "left").join(back, ["track", "peer"], "left").fillna(0)


def company_tracks(corpus: Corpus, occ: DataFrame, tracks: int) -> DataFrame:
    """Every track with its occurrences and the number of documents that have any."""
    found = occ.groupBy("track", "doc_id").agg(F.count("*").alias("n")).groupBy("track").agg(F.sum("n").alias("total"), F.count("*").alias("doc_count"))
    return track_names(corpus, tracks).join(found, "track", "left").fillna(0)


def company_coverage(occ: DataFrame, tracks: int) -> DataFrame:
    """Pairs ranked by the smaller share of occurrences that have the other within 25 tokens; pairs that never meet go."""
    near = nearest(occ, tracks).groupBy("track", "peer").agg((F.count_if(F.col("gap") < NEARBY) / F.count("*")).alias("coverage"))
    a, b = near.filter("track < peer"), near.filter("track > peer").select(F.col("peer").alias("track"), F.col("track").alias("peer"), F.col("coverage").alias("coverage_back"))
    pairs = a.join(b, ["track", "peer"]).join(docs_with_both(occ, tracks).filter("docs_with_both > 0"), ["track", "peer"])
    return pairs.withColumn("mutual", F.least("coverage", "coverage_back"))


_CANDIDATE = "doc_id {0}, start long, end long, anchor long, anchor_track int, score long, present int, total long, counts array<long>"


def _candidates(pdf: pd.DataFrame, weights: list[int], window: int, focus: tuple[int, int] | None, per_doc: int) -> list[tuple]:
    """The best windows of one document's runs of anchors."""
    n, tracks = int(pdf["token_count"].iloc[0]), len(weights)
    starts = [np.sort(pdf.loc[pdf["track"] == t, "pos"].to_numpy()) for t in range(tracks)]
    anchors = np.unique(np.concatenate(starts))
    begin = np.minimum(np.maximum(0, anchors - window // 2), max(0, n - window))
    end = np.minimum(n, begin + window)
    counts = np.stack([np.searchsorted(s, end) - np.searchsorted(s, begin) for s in starts], 1)
    present, total = (counts > 0).sum(1), counts.sum(1)
    by_weight = sorted(range(tracks), key=lambda t: (-weights[t], t))
    runs: list[tuple] = []
    best, first, last = None, -1, 0
    for k, anchor in enumerate(anchors.tolist()):
        if focus and not (counts[k][focus[0]] and counts[k][focus[1]]):
            continue
        if best is not None and (anchor - last >= window or anchor - first > 4 * window):
            runs.append(best)
            best = None
        if best is None:
            first = anchor
        last = anchor
        score = int(present[k]) * sum(w * isqrt(_SCALE * min(int(c), _COUNT_CAP)) for w, c in zip(weights, counts[k], strict=True))
        track = next(t for t in by_weight if (i := np.searchsorted(starts[t], anchor)) < len(starts[t]) and starts[t][i] == anchor)
        found = (-score, -int(present[k]), -int(total[k]), int(begin[k]), anchor, track, int(end[k]), counts[k].tolist())
        best = found if best is None or found[:6] < best[:6] else best
    if best is not None:
        runs.append(best)
    return sorted(runs, key=lambda r: r[:6])[:per_doc]


def destinations(corpus: Corpus, occ: DataFrame, tracks: int, window: int = WINDOW, focus: tuple[int, int] | None = None, results: int = RESULTS, per_doc: int = PER_DOC) -> DataFrame:
    """Up to 12 windows worth reading: those that many tracks, rare ones above all, meet in.

    Candidates come from each document on its own. The list is filled depth by depth: only the best of each
    depth can enter it, and the driver sees no more of them than it has places for.
    """
    if not 1 <= tracks <= 5 or focus and not 0 <= focus[0] < focus[1] < tracks:
        raise ValueError("1 to 5 tracks, and a focus of two of them in order")
    # Read twice below; kept from one document's candidates to the next request at most.
    occ = occ.select("track", "doc_id", "pos").persist()
    totals = {r.track: r.n for r in occ.groupBy("track").agg(F.count("*").alias("n")).collect()}
    if not totals or focus and not (totals.get(focus[0]) and totals.get(focus[1])):
        occ.unpersist()
        return corpus.spark.createDataFrame([], f"rank int, {_CANDIDATE.format(corpus.docs.schema['doc_id'].dataType.simpleString())}")
    most = max(totals.values())
    weights = [min(_MOST_WEIGHT, _SCALE * most // max(totals.get(t, 0), 1)) for t in range(tracks)]
    schema = _CANDIDATE.format(corpus.docs.schema["doc_id"].dataType.simpleString())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["doc_id"].iloc[0], r[3], r[6], r[4], r[5], -r[0], -r[1], -r[2], r[7]) for r in _candidates(pdf, weights, window, focus, per_doc)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.replace("array<long>", "x").split(", ")])

    found = occ.select("track", "doc_id", "pos").join(corpus.docs.select("doc_id", "token_count"), "doc_id").groupBy("doc_id").applyInPandas(run, schema)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("present"), F.desc("total"), "start", "anchor", "anchor_track")
    ranked = found.withColumn("depth", F.row_number().over(w) - 1).persist()
    active = ranked.filter("depth = 0").limit(results).count()
    order = [F.desc("score"), F.desc("present"), F.desc("total"), "doc_id", "start", "anchor", "anchor_track"]
    # With a document for every place the first depth fills the list; else there are few documents.
    pool = ranked.filter("depth = 0").orderBy(*order).limit(results).collect() if active >= results else ranked.orderBy("depth", *order).collect()
    ranked.unpersist()
    occ.unpersist()
    quota = min(per_doc, -(-results // max(1, min(active, 4))))
    taken: list = []
    for r in pool:
        own = [t for t in taken if t.doc_id == r.doc_id]
        if len(taken) < results and len(own) < quota and not any(t.start < r.end and r.start < t.end for t in own):
            taken.append(r)
    rows = [(k, *[r[c] for c in r.__fields__ if c != "depth"]) for k, r in enumerate(taken)]
    return corpus.spark.createDataFrame(rows, f"rank int, {schema}")


def snippets(corpus: Corpus, found: DataFrame, tokens: int = 48, chars: int = 400, size: int = 512) -> DataFrame:
    """``found`` with an excerpt that grows from its anchor, a token behind and one before in turn, within three limits."""
    t = corpus.tokens.select("doc_id", "pos", "char_start", "char_end").alias("t")
    near = found.alias("f").join(t, (F.col("f.doc_id") == F.col("t.doc_id")) & F.col("t.pos").between(F.col("anchor") - tokens, F.col("anchor") + tokens) & (F.col("t.pos") >= F.col("start")) & (F.col("t.pos") < F.col("end")))
    placed = near.groupBy("f.rank", "f.doc_id", "anchor").agg(F.array_sort(F.collect_list(F.struct("pos", "char_start", "char_end"))).alias("places"))
    texts = placed.join(corpus.documents.select("doc_id", "text"), "doc_id")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                places = [(p["pos"], p["char_start"], p["char_end"]) for p in r.places]
                lo = hi = next(k for k, p in enumerate(places) if p[0] == r.anchor)
                fits = lambda a, b: b - a < tokens and places[b][2] - places[a][1] <= chars and len(r.text[places[a][1] : places[b][2]].encode()) <= size
                ahead = behind = True
                while ahead or behind:
                    ahead = ahead and hi + 1 < len(places) and fits(lo, hi + 1)
                    hi += ahead
                    behind = behind and lo > 0 and fits(lo - 1, hi)
                    lo -= behind
                rows.append((r.rank, places[lo][0], places[hi][0] + 1, r.text[places[lo][1] : places[hi][2]]))
            yield pd.DataFrame(rows, columns=["rank", "snippet_start", "snippet_end", "snippet"])

    return found.join(texts.mapInPandas(grow, "rank int, snippet_start long, snippet_end long, snippet string"), "rank")


def snippet_marks(found: DataFrame, occ: DataFrame, most: int = 16) -> DataFrame:
    """Occurrences that reach into the excerpts of ``found`` (rows of ``snippets``), clipped to them, as token places
    of the document: the first ``most`` of each in reading order, with ``truncated`` where there are more."""
    # A dozen excerpts: the occurrences stay where they are.
    f, o = F.broadcast(found.select("rank", F.col("doc_id").alias("d"), "snippet_start", "snippet_end")), occ
    inside = (F.col("d") == F.col("doc_id")) & (F.col("pos") < F.col("snippet_end")) & (F.col("pos") + F.col("span") > F.col("snippet_start"))
    clipped = o.join(f, inside).select("rank", "track", "doc_id", F.greatest("pos", "snippet_start").alias("t0"), F.least(F.col("pos") + F.col("span"), "snippet_end").alias("t1"))
    w = Window.partitionBy("rank")
    numbered = clipped.withColumns({"nth": F.row_number().over(w.orderBy("t0", "t1", "track")), "truncated": F.count("*").over(w) > most})
    return numbered.filter(F.col("nth") <= most).drop("nth")
