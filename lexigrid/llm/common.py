"""Helpers shared by the training-data operators: shared storage and safe column names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; only where that is unset and all runs on one machine (tests) a
    temporary folder of this process. On a cluster an unset one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _OWN_DIR.get("dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(_forget, named)
    return named.rstrip("/")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    The files outlive a lost executor: a later stage reads them again instead of running
    everything before them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of_texts(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a column of texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing refers to any more.

    Spark removes them when the driver's garbage collector finds their handles; a driver with much
    memory and few objects seldom runs it, and the disks of all executors fill meanwhile.
    """
    for _ in range(2):  # the first round frees the plans, the second the shuffles that only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow_batches(spark: SparkSession, records: int = 500, size: str = "4m") -> None:
    """Bound what one Arrow batch to a Python worker holds, so that very long texts fit.

    Operators that settle something within a batch ask for larger ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
