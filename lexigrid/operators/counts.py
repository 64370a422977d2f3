"""Analyses that need only counts: ranked vocabulary, keyness, inventory, collocates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .corpus import PIECE_DOCS, TOKEN, Corpus, normal_keys
from .selection import selected_tokens

CLASSES = ("lexical", "numeral")


def term_counts(corpus: Corpus, runs: DataFrame | None = None) -> DataFrame:
    """doc_id, key, cls, n of all tokens, or of those that a selection holds."""
    if runs is None:
        return corpus.doc_terms.select("doc_id", "key", "cls", "n")
    return selected_tokens(corpus, runs).groupBy("doc_id", "key", "cls").agg(F.count("*").alias("n"))


def _check_page(offset: int, limit: int) -> None:
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 rows from 0 on")


def _with_totals(counts: DataFrame, *by: str) -> DataFrame:
    """``counts`` with key_total, the sum of n by ``by``.

    The sums are added up before the shuffle. A window instead would bring all documents that have a very
    common word into one task; this join broadcasts the sums or, where they are too many, reads two plain
    shuffles (hence the exchange by a hash of the columns), whose hot keys adaptive execution splits.
    """
    totals = counts.groupBy(*by).agg(F.sum("n").alias("key_total")).repartition(F.xxhash64(*by))
    return counts.join(totals, list(by))


def frequency_table(corpus: Corpus, doc_ids: DataFrame | None = None, runs: DataFrame | None = None, classes: tuple[str, ...] = CLASSES, min_count: int = 1,
                    min_docs: int = 1, pattern: str | None = None, dispersion: bool = True) -> DataFrame:
    """Every type of the selection with count, document frequency, rate and Gries' DP (0 below two parts with tokens)."""
    if not classes or set(classes) - set(CLASSES) or min(min_count, min_docs) < 1:
        raise ValueError("classes are lexical and numeral, minima at least 1")
    counts = term_counts(corpus, runs).filter(F.col("cls").isin(*classes))
    docs = corpus.docs.select("doc_id")
    if doc_ids is not None:
        counts, docs = counts.join(doc_ids, "doc_id", "left_semi"), docs.join(doc_ids, "doc_id", "left_semi")
    if runs is not None:
        docs = docs.join(runs, "doc_id", "left_semi")
    sizes = docs.join(counts.groupBy("doc_id").agg(F.sum("n").alias("size")), "doc_id", "left").fillna(0, ["size"])
    totals = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count_if(F.col("size") > 0).alias("parts"), F.coalesce(F.min("size"), F.lit(0)).alias("least"))
    out = counts
    if dispersion:
        part = F.col("n") / F.col("key_total")
        share = F.col("size") / F.col("total")
        # Only documents that have the type need a row: those without add their share, and all shares add up to 1.
        moved = _with_totals(counts, "key").join(sizes.crossJoin(F.broadcast(totals.select("total"))), "doc_id").withColumn("moved", F.abs(part - share) - share)
        out = moved.groupBy("key", "cls").agg(F.sum("n").alias("count"), F.count("*").alias("doc_freq"), F.sum("moved").alias("moved"))
    else:
        out = counts.groupBy("key", "cls").agg(F.sum("n").alias("count"), F.count("*").alias("doc_freq"))
    out = out.filter((F.col("count") >= min_count) & (F.col("doc_freq") >= min_docs))
    if pattern:
        out = out.filter(F.col("key").rlike(pattern))
    out = out.crossJoin(F.broadcast(totals))
    columns = ["key", "cls", "count", "doc_freq", stats.rate(F.col("count"), F.col("total")).alias("rate_per_10k")]
    if dispersion:
        dp = F.when(F.col("parts") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (1 + F.col("moved")))))
        columns += [dp.alias("dp"), F.when(F.col("parts") >= 2, dp / (1 - F.col("least") / F.col("total"))).alias("dp_norm")]
    return out.select(*columns)


def with_type_ids(corpus: Corpus, table: DataFrame) -> DataFrame:
    return table.join(corpus.type_ids().select("key", "type_id"), "key")


def frequency_page(corpus: Corpus, sort: str = "count", descending: bool = True, offset: int = 0, limit: int = 50, **options) -> DataFrame:
    """A page of the frequency table; ties by count, then by what was seen first."""
    _check_page(offset, limit)
    if sort.startswith("dp") and not options.get("dispersion", True):
        raise ValueError("sorting by dispersion needs dispersion")
    table = with_type_ids(corpus, frequency_table(corpus, **options))
    by = F.lower("key") if sort == "key" else F.when(F.col("cls") == "lexical", 0).otherwise(1) if sort == "class" else F.col(sort)
    return table.orderBy(by.desc() if descending else by.asc(), F.desc("count"), "type_id").offset(offset).limit(limit)


def keyness_table(corpus: Corpus, a: DataFrame, b: DataFrame, classes: tuple[str, ...] = CLASSES, min_count: int = 1, min_docs: int = 1, side: str = "both") -> DataFrame:
    """Types of two sets of documents (doc_id) with counts, rates, log ratio and its interval, signed G2, ranges and DP on each side."""
    if side not in ("a", "b", "both"):
        raise ValueError("side is a, b or both")
    if a.join(b, "doc_id", "left_semi").limit(1).count():
        raise ValueError("the sides must not share documents")
    sides = a.select("doc_id", F.lit("a").alias("side")).unionByName(b.select("doc_id", F.lit("b").alias("side")))
    merged, totals = _sides(corpus, sides, classes)
    kept = merged.filter(((F.col("count_a") + F.col("count_b")) >= min_count) & ((F.col("range_a") + F.col("range_b")) >= min_docs)).crossJoin(F.broadcast(totals))
    args = [F.col(c).cast("double") for c in ("count_a", "total_a", "count_b", "total_b")]
    ratio, margin = stats.log_ratio(*args), stats.log_ratio_margin(*args)

    def dp(s: str):
        moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (1 + F.col(f"moved_{s}"))))
        return F.when((F.col(f"parts_{s}") >= 2) & (F.col(f"count_{s}") > 0), moved).alias(f"dp_{s}")

    out = kept.select(
        "key", "cls", "count_a", "count_b", stats.rate(args[0], args[1]).alias("rate_a"), stats.rate(args[2], args[3]).alias("rate_b"), ratio.alias("log_ratio"),
        (ratio - margin).alias("lr_low"), (ratio + margin).alias("lr_high"), stats.g2(*args).alias("g2"), "range_a", "range_b", dp("a"), dp("b"),
    )
    return out if side == "both" else out.filter(F.col("log_ratio") > 0 if side == "a" else F.col("log_ratio") < 0)


def _sides(corpus: Corpus, sides: DataFrame, classes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    counts = term_counts(corpus).filter(F.col("cls").isin(*classes)).join(sides, "doc_id")
    sizes = counts.groupBy("side", "doc_id").agg(F.sum("n").alias("size"))
    per_side = sizes.groupBy("side").agg(F.sum("size").alias("total"), F.count("*").alias("parts"))
    pick = lambda col, s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(col))), F.lit(0))
    totals = per_side.agg(*[pick(c, s).alias(f"{c}_{s}") for c in ("total", "parts") for s in "ab"])
    share = F.col("size") / F.col("total")
    part = F.col("n") / F.col("key_total")
    moved = _with_totals(counts, "key", "side").join(sizes, ["side", "doc_id"]).join(F.broadcast(per_side.select("side", "total")), "side").withColumn("moved", F.abs(part - share) - share)
    one = lambda s, col: F.when(F.col("side") == s, col)
    merged = moved.groupBy("key", "cls").agg(
        *[F.coalesce(F.sum(one(s, F.col("n"))), F.lit(0)).alias(f"count_{s}") for s in "ab"], *[F.count(one(s, F.lit(1))).alias(f"range_{s}") for s in "ab"],
        *[F.sum(one(s, F.col("moved"))).alias(f"moved_{s}") for s in "ab"],
    )
    return merged, totals


def divergence(corpus: Corpus, a: DataFrame, b: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """bits of the Jensen-Shannon divergence between two sets of documents, and the number of types."""
    sides = a.select("doc_id", F.lit("a").alias("side")).unionByName(b.select("doc_id", F.lit("b").alias("side")))
    counts = term_counts(corpus).filter(F.col("cls").isin(*classes)).join(sides, "doc_id")
    types = counts.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in "ab"])
    totals = types.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    term = stats.jsd_term(F.col("a") / F.col("na"), F.col("b") / F.col("nb"))
    return types.crossJoin(F.broadcast(totals)).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(term))).alias("bits"), F.count("*").alias("types"))


#: What a keyness page can be sorted by.
KEYNESS_SORTS = ("log_ratio", "g2", "count_a", "count_b")


def keyness_page(corpus: Corpus, a: DataFrame, b: DataFrame, sort: str = "g2", descending: bool = True, offset: int = 0, limit: int = 50, **options) -> DataFrame:
    """A page of the keyness table with type_id and ``total``, the number of rows of all pages.

    Ties go by G2, then by the count of both sides (the larger first), then by what was seen first. A side
    that has no token of the wanted classes is an error.
    """
    _check_page(offset, limit)
    if sort not in KEYNESS_SORTS:
        raise ValueError(f"sort is one of {', '.join(KEYNESS_SORTS)}")
    classes = options.get("classes", CLASSES)
    for name, side in (("a", a), ("b", b)):
        if not corpus.doc_terms.filter(F.col("cls").isin(*classes)).join(side, "doc_id", "left_semi").limit(1).count():
            raise ValueError(f"side {name} has no token of these classes")
    # Read for the page and for the number of rows; the one of a page before goes.
    if "keyness" in corpus.kept:
        corpus.kept.pop("keyness").unpersist()
    table = corpus.kept["keyness"] = keyness_table(corpus, a, b, **options).persist()
    total = table.agg(F.count("*").alias("total"))
    by = F.col(sort).desc() if descending else F.col(sort).asc()
    page = with_type_ids(corpus, table).orderBy(by, F.desc("g2"), (F.col("count_a") + F.col("count_b")).desc(), "type_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def compare_sides(corpus: Corpus, doc_ids: list, rest: bool = True, others: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Side a: the named documents; side b: all others, or with ``rest`` off the named ``others``. Both must have documents and share none."""
    docs = corpus.docs.select("doc_id")
    a = docs.filter(F.col("doc_id").isin(doc_ids))
    b = docs.filter(~F.col("doc_id").isin(doc_ids)) if rest else docs.filter(F.col("doc_id").isin(others or []))
    if not a.limit(1).count() or not b.limit(1).count() or not rest and set(doc_ids) & set(others or []):
        raise ValueError("both sides need documents, and none in common")
    return a, b


def units(corpus: Corpus, unit: str = "sent_id", runs: DataFrame | None = None) -> DataFrame:
    """Sentences or paragraphs: doc_id, u_start and length. A selection has those whose first token it holds, whole."""
    found = corpus.tokens.groupBy("doc_id", unit).agg(F.min("pos").alias("u_start"), F.count("*").alias("length")).drop(unit)
    if runs is None:
        return found
    u, r = found.alias("u"), runs.alias("r")
    return u.join(r, (F.col("u.doc_id") == F.col("r.doc_id")) & (F.col("u_start") >= F.col("r_start")) & (F.col("u_start") < F.col("r_end"))).select("u.*")


def mattr(corpus: Corpus, window: int, runs: DataFrame | None = None) -> DataFrame:
    """doc_id and mattr: each range's mean type-token ratio over all windows, weighted by its tokens, and whether any was too short.

    A token adds to the windows that hold it and not the one before of its type, a closed count.
    """
    if not 1 <= window <= 2000:
        raise ValueError("the window has 1 to 2000 tokens")
    t = selected_tokens(corpus, runs).withColumn("i", F.col("pos") - F.col("r_start"))
    t = t.withColumn("before", F.coalesce(F.lag("i").over(Window.partitionBy("doc_id", "r_start", "key").orderBy("i")), F.lit(-1)))
    n = F.count("*").over(Window.partitionBy("doc_id", "r_start"))
    t = t.withColumn("n", n)
    first = F.greatest(F.col("before") + 1, F.col("i") - window + 1, F.lit(0))
    adds = F.greatest(F.lit(0), F.least(F.col("i"), F.col("n") - window) - first + 1)
    run = t.groupBy("doc_id", "r_start").agg(F.max("n").alias("n"), F.sum(adds).alias("adds"), F.count_if(F.col("before") < 0).alias("types"))
    value = F.when(F.col("n") <= window, F.col("types") / F.col("n")).otherwise(F.col("adds") / (F.lit(window) * (F.col("n") - window + 1)))
    return run.groupBy("doc_id").agg((F.sum(value * F.col("n")) / F.sum("n")).alias("mattr"), F.bool_or(F.col("n") <= window).alias("plain_ttr"))


def _unit_stats(u: DataFrame, name: str) -> DataFrame:
    return u.groupBy("doc_id").agg(
        F.count("*").alias(f"{name}s"), F.avg("length").alias(f"{name}_mean"), F.median("length").alias(f"{name}_median"),
        F.expr("percentile_disc(0.9) within group (order by length)").cast("long").alias(f"{name}_p90"),
    )


def inventory_docs(corpus: Corpus, window: int = 100, runs: DataFrame | None = None) -> DataFrame:
    """Per document: tokens, types, hapax legomena, sentence and paragraph lengths, type-token ratios."""
    docs = corpus.docs if runs is None else corpus.docs.join(runs, "doc_id", "left_semi")
    counts = term_counts(corpus, runs).groupBy("doc_id").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("cls") == "lexical", F.col("n")).otherwise(0)).alias("lexical"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax")
    )
    out = docs.select("doc_id", F.col("token_count").alias("full_tokens")).join(counts, "doc_id", "left")
    out = out.join(_unit_stats(units(corpus, "sent_id", runs), "sentence"), "doc_id", "left").join(_unit_stats(units(corpus, "para_id", runs), "paragraph").select("doc_id", "paragraphs", "paragraph_mean"), "doc_id", "left")
    out = out.join(mattr(corpus, window, runs), "doc_id", "left").fillna(0, ["tokens", "lexical", "types", "hapax", "sentences", "paragraphs"])
    return out.withColumn("ttr", F.col("types") / F.nullif(F.col("tokens"), F.lit(0)))


def inventory_totals(corpus: Corpus, runs: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """One row: documents, tokens by class, types, hapax legomena, units, characters and letters."""
    docs = corpus.docs if runs is None else corpus.docs.join(runs, "doc_id", "left_semi")
    types = term_counts(corpus, runs).groupBy("key", "cls").agg(F.sum("n").alias("n"))
    readable = types.withColumns({
        "chars": F.length(F.regexp_replace("key", r"[^\p{L}\p{Nd}]", "")) * F.col("n"), "letters": F.length(F.regexp_replace("key", r"[^\p{L}]", "")) * F.col("n"),
    })
    lexical = F.when(F.col("cls") == "lexical", F.col("n")).otherwise(0)
    one = readable.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(lexical), F.lit(0)).alias("lexical"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("readability_characters"), F.coalesce(F.sum("letters"), F.lit(0)).alias("readability_letters"),
    )
    extent = selected_tokens(corpus, runs).groupBy("doc_id", "r_start").agg((F.max("char_end") - F.min("char_start")).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("chars"))
    small = docs.agg(F.count("*").alias("documents")).crossJoin(F.broadcast((expected or corpus.documents).join(corpus.docs, "doc_id", "left_anti").agg(F.count("*").alias("missing"))))
    for name, unit in (("sentences", "sent_id"), ("paragraphs", "para_id")):
        small = small.crossJoin(F.broadcast(units(corpus, unit, runs).agg(F.count("*").alias(name))))
    return small.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(extent)).withColumn("numeral", F.col("tokens") - F.col("lexical"))


def rhythm(corpus: Corpus, bins: int, runs: DataFrame | None = None) -> DataFrame:
    """Per document and bin: sentences that begin there, their mean and median length, and selected tokens."""
    if not 1 <= bins <= 256:
        raise ValueError("1 to 256 bins")
    docs = corpus.docs.filter("token_count > 0") if runs is None else corpus.docs.filter("token_count > 0").join(runs, "doc_id", "left_semi")
    width = F.ceil(F.col("token_count") / bins)
    frame = docs.select("doc_id", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) / F.col("width"))).cast("int")
    found = units(corpus, "sent_id", runs).join(docs.select("doc_id", width.alias("width")), "doc_id").groupBy("doc_id", at("u_start").alias("bin")).agg(
        F.count("*").alias("sentences"), F.avg("length").alias("mean"), F.median("length").alias("median")
    )
    tokens = selected_tokens(corpus, runs).join(docs.select("doc_id", width.alias("width")), "doc_id").groupBy("doc_id", at("pos").alias("bin")).agg(F.count("*").alias("bin_tokens"))
    out = frame.join(found, ["doc_id", "bin"], "left").join(tokens, ["doc_id", "bin"], "left").fillna(0, ["sentences", "bin_tokens"])
    return out.select("doc_id", "bin", (F.col("bin") * F.col("width")).alias("bin_start"), "bin_tokens", "sentences", "mean", "median")


def _mtld_way(keys: list[int], threshold: float) -> float:
    """Tokens for each factor of one way through ``keys``: a fold that begins anew where the type-token ratio falls to the threshold."""
    seen: set[int] = set()
    n, factors, ratio = 0, 0.0, 1.0
    for k in keys:
        seen.add(k)
        n += 1
        ratio = len(seen) / n
        if ratio <= threshold:
            seen.clear()
            n, factors, ratio = 0, factors + 1.0, 1.0
    factors += (1 - ratio) / (1 - threshold)
    return len(keys) / factors if factors > 0 else float(len(keys))


def mtld(corpus: Corpus, threshold: float = 0.72) -> DataFrame:
    """doc_id and mtld of documents with tokens: the mean of both ways through their keys in order. A text is one row, so nothing is moved."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PIECE_DOCS):
                part = batch.slice(first, PIECE_DOCS)
                stops = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part.column("tk")), 0), np.int64)).tolist()
                codes = np.asarray(normal_keys(pc.list_flatten(part.column("tk"))).dictionary_encode().indices if stops[-1] else [], np.int64).tolist()
                rows = [codes[a:b] for a, b in zip([0, *stops], stops, strict=False)]
                values = [(_mtld_way(k, threshold) + _mtld_way(k[::-1], threshold)) / 2 if k else None for k in rows]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "mtld": pa.array(values, pa.float64())})

    cut = corpus.documents.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tk"))
    return cut.mapInArrow(fold, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, mtld double").filter("mtld is not null")


def collocates(corpus: Corpus, node: str, min_both: int = 2) -> DataFrame:
    """Words that share sentences with ``node`` (folded by case): sentence counts, logDice, PMI and t-score."""
    present = corpus.tokens.filter("cls = 'lexical'").select("doc_id", "sent_id", F.lower("key").alias("word")).distinct()
    around = present.filter(F.col("word") == node.lower()).select("doc_id", "sent_id")
    both = present.join(around, ["doc_id", "sent_id"]).filter(F.col("word") != node.lower()).groupBy("word").agg(F.count("*").alias("together"))
    alone = present.groupBy("word").agg(F.count("*").alias("y"))
    small = around.agg(F.count("*").alias("x")).crossJoin(F.broadcast(corpus.tokens.select("doc_id", "sent_id").distinct().agg(F.count("*").alias("n"))))
    scored = both.filter(F.col("together") >= min_both).join(alone, "word").crossJoin(F.broadcast(small))
    c = {k: F.col(k).cast("double") for k in ("together", "x", "y", "n")}
    return scored.select("word", "together", "x", "y", stats.log_dice(c["together"], c["x"], c["y"]).alias("log_dice"), stats.pmi(c["together"], c["x"], c["y"], c["n"]).alias("pmi"), stats.t_score(c["together"], c["x"], c["y"], c["n"]).alias("t"))


def compare_profile(corpus: Corpus, sides: DataFrame, window: int = 100) -> DataFrame:
    """Per side (doc_id, side): tokens, types, units, MATTR over documents longer than the window, readability."""
    docs = inventory_docs(corpus, window).join(sides, "doc_id")
    long_ = F.when(~F.col("plain_ttr"), F.col("tokens"))
    per = docs.groupBy("side").agg(
        F.sum("tokens").alias("tokens"), F.sum("sentences").alias("sentences"), F.sum("paragraphs").alias("paragraphs"), (F.sum(F.col("mattr") * long_) / F.sum(long_)).alias("mattr")
    )
    words = term_counts(corpus).join(sides, "doc_id").groupBy("side", "key").agg(F.sum("n").alias("n"))
    types = words.groupBy("side").agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"), F.sum(F.length(F.regexp_replace("key", r"[^\p{L}\p{Nd}]", "")) * F.col("n")).alias("chars"))
    out = per.join(types, "side")
    return out.select(
        "side", "tokens", "types", "sentences", "paragraphs", "mattr", (F.col("hapax") * 1000 / F.col("types")).alias("hapax_per_1k"), (F.col("tokens") / F.col("sentences")).alias("tokens_per_sentence"),
        (F.col("tokens") / F.col("paragraphs")).alias("tokens_per_paragraph"), stats.readability(F.col("chars"), F.col("tokens"), F.col("sentences")).alias("ari"),
    )
