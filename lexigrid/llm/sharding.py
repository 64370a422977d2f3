"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Every (key, shard) pair draws a number from MD5; the shard whose weighted draw is largest takes the
row. A shard that is added draws on its own and takes only the rows where its draw beats all others,
so every other row stays where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, text_or_empty

#: Sub-buckets of a shard in which slots are counted side by side.
SLOT_BUCKETS = 256
#: Slots of a repeated row that are written out at a time.
SLOT_RUN = 1 << 16


def draw(key: Column, shard: int) -> Column:
    """52 bits of MD5 over ``key:shard``, as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number (0-based) that ``key`` (a string) belongs to; ties go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and not empty")
    equal = len(set(weights)) == 1

    def score(shard: int, weight: float) -> Column:
        d = draw(key, shard)
        return d if equal else F.lit(float(weight)) / -F.log((d + F.lit(0.5)) / F.lit(2.0**52))

    best = [F.struct(score(s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -(best[0] if len(best) == 1 else F.greatest(*best))["shard"]


def shard_records(df: DataFrame, key: str, text: str, weights: Sequence[float], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Put every row of ``df`` into a shard and give it a slot there.

    Returns key, size (UTF-8 bytes of the text plus 8), text_crc32, law ('key'), shard, slot (0, 1, 2 ...
    without gaps in each shard) and grown_shard (with one more shard of the mean weight).

    Null texts count as empty. A null key is a key like others (all such rows share a shard). Repeated
    rows are counted before the shuffle and get consecutive slots, so the copies of a hot row move as one
    row; one task writes them out again, SLOT_RUN at a time. Other columns are not carried along, whatever
    their names. An empty table gives none.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    mean = sum(weights) / len(weights)
    kind = df.schema[key].dataType
    keyed = df.select(
        F.col(key).alias("key"),
        name.alias("name"),
        F.octet_length(text_or_empty(text)).cast("long").alias("bytes"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
    )
    bucket = F.pmod(draw(F.col("name"), -1), F.lit(buckets)).alias("bucket")
    # The law looks at keys only, so the counts need no text.
    counts = (
        df.select(name.alias("name")).select(rendezvous(F.col("name"), weights).alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = keyed.groupBy("key", "name", "bytes", "text_crc32").agg(F.count("*").alias("copies"))
    shard = rendezvous(F.col("name"), weights)
    placed = rows.select("*", shard.alias("shard"), bucket)
    # All draws again and one more, which alone can take a row away from its shard.
    grown = rendezvous(F.col("name"), [*weights, mean])
    within = Window.partitionBy("shard", "bucket").orderBy("name", "bytes", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    slotted = placed.withColumn("seen", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    # starts has at most shards x buckets rows, whatever the size of the data.
    joined = slotted.join(F.broadcast(starts), ["shard", "bucket"])
    at = F.col("first") + F.col("seen")
    # No array is longer than SLOT_RUN, nor are there more than a SLOT_RUN-th of the copies.
    runs = joined.select("*", at.alias("at"), F.explode(F.sequence(at, at + F.col("copies") - 1, F.lit(SLOT_RUN).cast("long"))).alias("run"))
    slots = F.sequence("run", F.least(F.col("run") + SLOT_RUN, F.col("at") + F.col("copies")) - 1)
    return runs.select(
        F.col("key").cast(kind).alias(key),
        (F.col("bytes") + 8).alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast(T.IntegerType()).alias("shard"),
        F.explode(slots).alias("slot"),
        grown.cast(T.IntegerType()).alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` into 24 equal shards by doc_id."""
    return shard_records(documents(spark, sf_dir), "doc_id", "text", [1.0] * 24)


def _oracle() -> str:
    draws = lambda n: ", ".join(
        f"{{'score': ('0x' || substr(md5(name || ':{s}'), 1, 13))::BIGINT, 'shard': {-s}}}" for s in range(n)
    )
    table = (
        "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), "
        "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i)))"
    )
    return f"""
WITH crc AS (SELECT {table} AS tab),
base AS (
  SELECT doc_id, doc_id::VARCHAR AS name, coalesce(text, '') AS body FROM documents
), digest AS (
  SELECT body, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM (SELECT DISTINCT body FROM base), crc
), placed AS (
  SELECT doc_id, name, strlen(body)::BIGINT + 8 AS size, text_crc32,
    (-list_max([{draws(24)}]).shard)::INTEGER AS shard,
    (-list_max([{draws(25)}]).shard)::INTEGER AS grown_shard
  FROM base JOIN digest USING (body)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard
    ORDER BY ('0x' || substr(md5(name || ':-1'), 1, 13))::BIGINT % {SLOT_BUCKETS}, name, size, text_crc32) - 1 AS slot
FROM placed
"""


QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": _oracle()}
