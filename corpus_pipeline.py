"""From documents to token ids: toxic texts go, one of each group of near-duplicates stays, benchmark passages
and secrets are taken out, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import bpe, decontamination, jaccard, secrets, toxicity
from lexigrid.llm.common import materialise


def _with_size(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars counted anew, if the table has that column."""
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else after


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold. Null and empty texts stay (no voter fires on them)."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, score = toxicity.score_documents(docs, model)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id. Rows without words stay."""
    return jaccard.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; rows that are more than half such passages go."""
    return _with_size(docs, decontamination.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays."""
    found = secrets.find_secrets(docs, "text")
    (name,) = [c for c in found.columns if c not in docs.columns]
    return _with_size(docs, secrets.redact(found, "text", name).drop(name))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, and digest of what they decode to."""
    return bpe.encode_documents(docs.select("doc_id", "text"), memory=100_000).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The first stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
