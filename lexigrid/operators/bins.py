"""Where occurrences fall: trends over bins, smoothing, comparison with a range, dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .corpus import Corpus

MOST_EXACT, BUCKETS = 50_000, 4096


def _frame(corpus: Corpus, bins: int | None, width: int | None, runs: DataFrame | None) -> DataFrame:
    docs = corpus.docs.filter("token_count > 0")
    if runs is not None:
        docs = docs.join(runs, "doc_id", "left_semi")
    n = F.col("token_count")
    w = F.ceil(n / bins) if bins else F.lit(width).cast("long")
    rows = F.lit(bins).cast("long") if bins else F.ceil(n / width)
    sized = docs.select("doc_id", "token_count", "seq_base", w.alias("width"), rows.alias("n_bins"))
    return sized.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))


def track_names(corpus: Corpus, n: int) -> DataFrame:
    """The numbers of the tracks that a request names, of which some may occur nowhere."""
    return corpus.spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias("track"))


def trend(corpus: Corpus, occ: DataFrame, tracks: int, bins: int | None = None, width: int | None = None, runs: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    """Occurrences (track, doc_id, pos) per bin that their first token falls into; bins begin anew in each document.

    Rows are there for each of ``tracks`` tracks, with zeros for those that occur nowhere.

    Either ``bins`` equal ones (4 to 200; the last may be empty) or as many of ``width`` tokens (250 to
    50,000) as needed. Documents without tokens have no rows.
    """
    if (bins is None) == (width is None) or bins is not None and not 4 <= bins <= 200 or width is not None and not 250 <= width <= 50_000:
        raise ValueError("either 4 to 200 bins or 250 to 50,000 tokens a bin")
    frame = _frame(corpus, bins, width, runs)
    if most_rows is not None and frame.count() > most_rows:
        raise ValueError(f"more than {most_rows} bins")
    start = F.col("bin") * F.col("width")
    frame = frame.withColumn("bin_start", start).withColumn("bin_end", F.least(start + F.col("width"), F.col("token_count")))
    whole = F.greatest(F.lit(0).cast("long"), F.col("bin_end") - F.col("bin_start"))
    if runs is None:
        frame = frame.withColumn("bin_tokens", whole)
    else:
        f, r = frame.alias("f"), runs.alias("r")
        both = F.greatest(F.lit(0), F.least("bin_end", "r_end") - F.greatest("bin_start", "r_start"))
        held = f.join(r, F.col("f.doc_id") == F.col("r.doc_id")).groupBy("f.doc_id", "bin").agg(F.sum(both).cast("long").alias("bin_tokens"))
        frame = frame.join(held, ["doc_id", "bin"], "left").fillna(0, ["bin_tokens"])
    shape = frame.select("doc_id", "width", "n_bins").distinct()
    at = F.least(F.col("n_bins") - 1, F.floor(F.col("pos") / F.col("width")))
    counts = occ.join(shape, "doc_id").groupBy("track", "doc_id", at.alias("bin")).agg(F.count("*").alias("count"))
    # Tracks are the few that a request names.
    out = frame.crossJoin(F.broadcast(track_names(corpus, tracks))).join(counts, ["track", "doc_id", "bin"], "left").fillna(0, ["count"])
    return out.select("track", "doc_id", "bin", "bin_start", "bin_tokens", "count", stats.rate(F.col("count"), F.col("bin_tokens")).alias("rate_per_10k"), "seq_base", F.col("token_count").alias("doc_tokens"))


def smooth(rows: DataFrame, window: int = 5) -> DataFrame:
    """``smoothed``: the token-weighted mean rate of bins around, within the document; the raw rate where fewer than
    half of them have tokens, null where the bin itself has none."""
    if window not in (3, 5, 7, 9):
        raise ValueError("the window is 3, 5, 7 or 9 bins")
    w = Window.partitionBy("track", "doc_id").orderBy("bin").rowsBetween(-(window // 2), window // 2)
    tokens = F.col("bin_tokens")
    mean = F.sum(F.col("rate_per_10k") * tokens).over(w) / F.sum(tokens).over(w)
    enough = F.count_if(tokens > 0).over(w) >= (window + 1) // 2
    return rows.withColumn("smoothed", F.when(tokens > 0, F.when(enough, mean).otherwise(F.col("rate_per_10k"))))


def range_compare(corpus: Corpus, occ: DataFrame, tracks: int, runs: DataFrame, evidence: float = 5.0) -> DataFrame:
    """Per track: occurrences and tokens inside ranges and outside them in the whole corpus, and their contrast.

    ``evidenced``: the smaller side would hold ``evidence`` occurrences at the pooled rate. ``undefined``
    says why there is no contrast: whole-corpus (nothing lies outside), empty-range or no-occurrences.
    """
    total = corpus.docs.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    inside = runs.agg(F.coalesce(F.sum(F.col("r_end") - F.col("r_start")), F.lit(0)).alias("tokens_in"))
    o, r = occ.alias("o"), runs.alias("r")
    held = (F.col("o.doc_id") == F.col("r.doc_id")) & (F.col("pos") >= F.col("r_start")) & (F.col("pos") < F.col("r_end"))
    hits = o.join(r, held, "left").groupBy("track").agg(F.count("*").alias("hits"), F.count("r_start").alias("hits_in"))
    every = track_names(corpus, tracks).join(hits, "track", "left").fillna(0, ["hits", "hits_in"])
    row = every.crossJoin(F.broadcast(total.crossJoin(F.broadcast(inside)))).withColumns({"hits_out": F.col("hits") - F.col("hits_in"), "tokens_out": F.col("tokens") - F.col("tokens_in")})
    why = F.when(F.col("tokens_out") <= 0, "whole-corpus").when(F.col("tokens_in") <= 0, "empty-range").when(F.col("hits") == 0, "no-occurrences")
    defined = lambda c: F.when(why.isNull(), c)
    expected = F.col("hits") / F.nullif(F.col("tokens"), F.lit(0)) * F.least("tokens_in", "tokens_out")
    contrast = stats.rate_contrast(F.col("hits_in"), F.col("tokens_in"), F.col("hits_out"), F.col("tokens_out"))
    return row.select(
        "track", "hits_in", "tokens_in", "hits_out", "tokens_out", defined(contrast).alias("contrast"), defined(expected).alias("expected_min"),
        defined(expected >= evidence).alias("evidenced"), why.alias("undefined"),
    )


def book_totals(rows: DataFrame) -> DataFrame:
    """Trend rows summed per track and document."""
    total = rows.groupBy("track", "doc_id").agg(F.sum("count").alias("count"), F.sum("bin_tokens").alias("tokens"))
    return total.withColumn("rate_per_10k", stats.rate(F.col("count"), F.col("tokens")))


def catalog_totals(rows: DataFrame) -> DataFrame:
    """Documents and, with a null doc_id, all of them together, per track."""
    total = book_totals(rows).rollup("track", "doc_id").agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("g"))
    return total.filter("g < 3").select("track", "doc_id", "count", "tokens", stats.rate(F.col("count"), F.col("tokens")).alias("rate_per_10k"))


def bucket_plan(corpus: Corpus, budget: int = BUCKETS) -> DataFrame:
    """doc_id, token_count, buckets: one for each document with tokens, the rest of the budget by size.

    With as many documents as buckets each has one. Below that, the largest remainders of full sizes decide,
    no document gets more buckets than tokens, and what it can't take goes round again.
    """
    docs = corpus.docs.filter("token_count > 0").select("doc_id", "token_count")
    if docs.limit(budget).count() >= budget:
        return docs.withColumn("buckets", F.lit(1))
    rows = [(r.doc_id, r.token_count) for r in docs.orderBy("doc_id").collect()]  # fewer than ``budget``
    size = [n for _, n in rows]
    given, left = [1] * len(rows), budget - len(rows)
    while left > 0 and (open_ := [i for i in range(len(rows)) if given[i] < size[i]]):
        weight = sum(size[i] for i in open_)
        share = {i: divmod(left * size[i], weight) for i in open_}
        extra = set(sorted(open_, key=lambda i: (-share[i][1], i))[: left - sum(s for s, _ in share.values())])
        for i in open_:
            more = min(share[i][0] + (i in extra), size[i] - given[i])
            given[i] += more
            left -= more
    plan = [(d, n, g) for (d, n), g in zip(rows, given, strict=True)]
    return corpus.spark.createDataFrame(plan, f"doc_id {corpus.docs.schema['doc_id'].dataType.simpleString()}, token_count long, buckets int")


def _bucket(pos: Column) -> Column:
    """Bucket b of k begins at floor(b * extent / k)."""
    return F.floor(((pos + 1) * F.col("buckets") - 1) / F.col("token_count"))


def dispersion_exact(occ: DataFrame, most: int | None = MOST_EXACT) -> DataFrame:
    """Every occurrence of the tracks that have ``most`` at most."""
    if most is None:
        return occ.select("track", "doc_id", "pos", "span")
    few = occ.groupBy("track").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return occ.join(F.broadcast(few.select("track")), "track", "left_semi").select("track", "doc_id", "pos", "span")


def dispersion_density(corpus: Corpus, occ: DataFrame, budget: int = BUCKETS) -> DataFrame:
    """Occurrences per bucket, with its first token and its share of the track's fullest bucket."""
    plan = bucket_plan(corpus, budget)
    found = occ.join(plan, "doc_id").withColumn("bucket", _bucket(F.col("pos")))
    start = F.floor(F.col("bucket") * F.col("token_count") / F.col("buckets"))
    out = found.groupBy("track", "doc_id", "bucket", start.alias("bucket_start")).agg(F.count("*").alias("count"))
    fullest = out.groupBy("track").agg(F.max("count").alias("most"))
    return out.join(F.broadcast(fullest), "track").select("track", "doc_id", "bucket", "bucket_start", "count", (F.col("count") / F.col("most")).alias("intensity"))


def slot_map(corpus: Corpus, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ordinal in the corpus and slot among the selected documents, both from 0 in declared order."""
    from .corpus import running_total

    chosen = corpus.docs.select("doc_id").join(doc_ids.select("doc_id").distinct().withColumn("chosen", F.lit(1)), "doc_id", "left").fillna(0, ["chosen"]).withColumn("one", F.lit(1))
    numbered = running_total(running_total(chosen, "doc_id", "one", "ordinal"), "doc_id", "chosen", "slot")
    return numbered.filter("chosen = 1").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("slot").cast("long").alias("slot"))


def trend_display(rows: DataFrame, view: str = "rate") -> DataFrame:
    """Trend rows with ``value``: the rate per 10,000 tokens or the count."""
    if view not in ("rate", "count"):
        raise ValueError("the view is rate or count")
    return rows.withColumn("value", F.col("rate_per_10k") if view == "rate" else F.col("count").cast("double"))


def bar_scale(rows: DataFrame, value: str = "log_ratio") -> DataFrame:
    """``bar``: the size of ``value`` in percent of the largest one, which counts as 1 at least."""
    most = rows.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(F.abs(F.col(value))), F.lit(0.0))).alias("most_"))
    return rows.crossJoin(F.broadcast(most)).withColumn("bar", F.abs(F.col(value)) / F.col("most_") * 100).drop("most_")
