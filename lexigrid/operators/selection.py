"""Selections: documents and half-open token ranges in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import Corpus


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """doc_id, r_start, r_end with overlapping and touching ranges of a document merged."""
    before = Window.partitionBy("doc_id").orderBy("r_start", "r_end").rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.withColumn("open", F.coalesce(F.col("r_start") > F.max("r_end").over(before), F.lit(True)).cast("int"))
    run = F.sum("open").over(Window.partitionBy("doc_id").orderBy("r_start", "r_end").rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("run")


def resolve(corpus: Corpus, doc_ids: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """The merged ranges of a selection; a document without any is selected as a whole."""
    docs = corpus.docs if doc_ids is None else corpus.docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = docs.select("doc_id", F.lit(0).cast("long").alias("r_start"), F.col("token_count").alias("r_end"))
    if ranges is None:
        return whole
    bad = ranges.join(corpus.docs, "doc_id", "left").filter("token_count is null or r_start < 0 or r_end > token_count or r_start >= r_end")
    if bad.limit(1).count():
        raise ValueError("ranges must lie in their documents and not be empty")
    merged = merge_ranges(ranges.select("doc_id", "r_start", "r_end"))
    return whole.join(merged.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(merged.join(docs.select("doc_id"), "doc_id", "left_semi"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id of the documents in which two selections share a token; ranges that touch don't."""
    x, y = a.alias("x"), b.alias("y")
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.r_start") < F.col("y.r_end")) & (F.col("y.r_start") < F.col("x.r_end"))
    return x.join(y, same, "left_semi").select("doc_id").distinct()


def commit_range(corpus: Corpus, first_doc: int, first_token: int, last_doc: int, last_token: int) -> DataFrame:
    """From one token to another, both included: one range per document between that has tokens."""
    if (last_doc, last_token) < (first_doc, first_token):
        first_doc, first_token, last_doc, last_token = last_doc, last_token, first_doc, first_token
    docs = corpus.docs.filter(F.col("doc_id").between(first_doc, last_doc) & (F.col("token_count") > 0))
    start = F.when(F.col("doc_id") == first_doc, F.lit(first_token)).otherwise(F.lit(0)).cast("long")
    end = F.when(F.col("doc_id") == last_doc, F.least(F.lit(last_token + 1), F.col("token_count"))).otherwise(F.col("token_count")).cast("long")
    return docs.select("doc_id", start.alias("r_start"), end.alias("r_end")).filter("r_start < r_end")


def missing(expected: DataFrame, ready: DataFrame) -> DataFrame:
    return expected.select("doc_id").join(ready, "doc_id", "left_anti")


def selected_tokens(corpus: Corpus, runs: DataFrame | None) -> DataFrame:
    """Tokens that a selection holds (each is in one range at most), with the start of its range."""
    if runs is None:
        return corpus.tokens.withColumn("r_start", F.lit(0).cast("long"))
    t, r = corpus.tokens.alias("t"), runs.alias("r")
    inside = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.col("pos") >= F.col("r_start")) & (F.col("pos") < F.col("r_end"))
    return t.join(r, inside).select("t.*", "r_start")


def whole_corpus(corpus: Corpus, runs: DataFrame | None) -> None:
    """ValueError unless ``runs`` (None: no selection) are all documents as a whole, which some analyses need."""
    if runs is None:
        return
    held = merge_ranges(runs).alias("r")
    lacking = corpus.docs.filter("token_count > 0").alias("d").join(held, (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("r_start") <= 0) & (F.col("r_end") >= F.col("token_count")), "left_anti")
    if lacking.limit(1).count():
        raise ValueError("this analysis needs the whole corpus")
