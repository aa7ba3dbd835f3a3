"""Reading the named tables of a data folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; the path may be in any store that Spark can read."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which the driver and all executors must share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """A table that several parts of a plan read, written once below spark.checkpoint.dir and read again.

    by: columns whose values become folders.  codec: of its Parquet files, else the session's.
    """
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by or []).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 300_000


def few(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are counted to be BROADCAST_ROWS at most; else it joins by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """The table over as many tasks as there are cores, where its files would make fewer: for work that is much dearer than a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
