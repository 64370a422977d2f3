"""Documents that keep arriving: each micro-batch is tokenised and appended to the token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import tokenize


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Start a query over Parquet files of documents (doc_id, text ...) that ends when all present files are in.

    The batch number is a folder of the table, which a batch that runs again replaces, so tokens are there
    exactly once. A document that comes again has the tokens of its last batch (``latest``).
    """
    docs = spark.readStream.schema(schema).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        tokenize(batch.dropDuplicates(["doc_id"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The token table with each document as its last batch had it."""
    tokens = spark.read.option("basePath", target).parquet(target)
    newest = tokens.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return tokens.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")
