"""Helpers shared by the operators: the shared scratch folder, stored tables, range buckets, input checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir where it is set.

    Without one, a local session gets a temporary folder; on a cluster RuntimeError says what to set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of whole texts: the JVM and the worker each hold a batch, which of 10,000 texts is tens of MB a task.
TEXT_ROWS = 1000


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gives Python at most TEXT_ROWS rows at once."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The shuffle files of the write are removed when it is done.  texts: Python takes whole texts for it, in small batches.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        with text_batches(spark) if texts else nullcontext():
            df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for these tables (or for what they select from), when nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that may be broadcast: some tens of MB of keys.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are counted to be BROADCAST_ROWS at most; else it joins by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by exact name, so that other columns can't clash with an operator's own."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may differ in case only, or hold dots
    return plain.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cuts(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n-1 values of the key that split its rows about evenly, ascending; the result has n entries at most."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(F.col(key), F.array(*map(F.lit, at)), F.lit(20 * n)).alias("q")).head()
    return sorted(set(row["q"])) if row and row["q"] else []


#: Bounds up to which a key is compared in generated code.
TREE = 512


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key (null: 0), by a binary search.

    Few bounds become a tree of comparisons, many an array that a fold halves step by step.
    """
    if len(bounds) <= TREE:

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        return tree(0, len(bounds))
    values = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= key, at + step).otherwise(at))
