"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v): hang each node's larger (or own and smaller) neighbours on its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # A node's neighbours meet in a map-side minimum. The exchange by a hash of u keeps that aggregate out of the
    # join's stage: only a join of two plain shuffles has the neighbours of a hub split by adaptive execution.
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(F.xxhash64("u"))
    near = both.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v); a component is named by its smallest node.

    Each round is written to the shared folder, and the round before it removed. Loops and repeated edges
    change nothing; without edges the result is empty.
    """
    spark, paths = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        paths.append(fresh_path(spark, "edges"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    now = written(edges.filter("u <> v").select("u", "v").distinct())
    before = None
    for _ in range(most_rounds):
        now = written(_star(written(_star(now, True)), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in paths[:-1]:
            drop_path(spark, path)
        del paths[:-1]
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
    raise RuntimeError("components did not settle")
