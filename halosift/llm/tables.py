"""What the operators share: tables, splits by checksum, pinned tables, batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.session import pin, shared_dir

BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24

__all__ = ["table", "checksum", "spread", "fitted", "pin", "shared_dir", "small_batches", "send"]


def small_batches(spark: SparkSession) -> None:
    """Rows of long texts travel to Python in batches of at most ``BATCH_ROWS`` and about ``BATCH_BYTES``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checksum(key: str | Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def spread(df: DataFrame) -> int:
    """Partitions for a repartition of work as heavy as reading ``df``."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fitted(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in as many partitions as those need and the cores can take, or as it is if it has fewer."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def send(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A function that gives ``thing`` in a task; its class travels along, so executors need no package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)
