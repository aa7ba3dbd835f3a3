"""Calls that are reserved, run and settled: each gets one outcome, also when its run was interrupted.

Events (ledger, id, kind, tokens, ts): kind reserve, settle (tokens as reported) or fail.  A call's reservation is its first one.
It is settled by the first settlement from then up to a time limit; without one it failed as interrupted and keeps its
reservation.  Settlements without a reservation are told apart, further ones are counted.  The stream and the batch give
equal rows: the stream decides a call when the watermark has passed its deadline, so arrival order changes nothing.
State is a few rows a call, keyed by call, and goes with its timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and list state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("reserve", "settle", "fail")
OUT = "ledger string, id string, status string, error string, reserved_tokens long, accounted_tokens long, settlements int"


def _valid(events: DataFrame) -> DataFrame:
    """Events of a known kind with ledger, id and time; tokens null or below 0 count 0."""
    kept = events.filter(F.col("kind").isin(*KINDS) & F.col("ledger").isNotNull() & F.col("id").isNotNull() & F.col("ts").isNotNull())
    return kept.select(F.col("ledger").cast("string").alias("ledger"), F.col("id").cast("string").alias("id"), "kind", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))


def outcomes(events: DataFrame, limit: timedelta) -> DataFrame:
    """The outcome of each call in a table of events, as if all its deadlines had passed: columns OUT.

    Two aggregations that combine before they shuffle, and a join by call between them; nothing gathers a call's events.
    """
    rows = _valid(events).withColumn("at", F.unix_micros("ts"))
    reserved = rows.filter("kind = 'reserve'").groupBy("ledger", "id").agg(F.min(F.struct("at", "tokens")).alias("r"))
    after = (F.col("at") >= F.col("r.at")) & (F.col("at") <= F.col("r.at") + limit // timedelta(microseconds=1))
    own = F.when(F.col("r").isNull() | after, F.struct("at", F.col("kind") == "fail", "kind", "tokens"))
    met = rows.filter("kind != 'reserve'").join(reserved, ["ledger", "id"], "left").groupBy("ledger", "id").agg(F.min(own).alias("s"), F.count(F.lit(1)).cast("int").alias("n"))
    each = reserved.join(met, ["ledger", "id"], "full")
    kind = F.col("s.kind")
    status = F.when(F.col("r").isNull(), "unreserved").when(kind == "settle", "completed").otherwise("failed")
    error = F.when(F.col("r").isNotNull() & kind.isNull(), "interrupted").when(F.col("r").isNotNull() & (kind == "fail"), "reported")
    tokens = F.when(kind == "settle", F.col("s.tokens")).otherwise(F.coalesce("r.tokens", F.lit(0)))
    return each.select("ledger", "id", status.alias("status"), error.alias("error"), F.coalesce("r.tokens", F.lit(0)).alias("reserved_tokens"), tokens.alias("accounted_tokens"), F.coalesce("n", F.lit(0)).alias("settlements"))


class _Calls(StatefulProcessor):
    """Keeps a call's reservation and settlements until its timer, then gives its outcome."""

    def __init__(self, limit: timedelta):
        self.limit = limit // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reserved = handle.getValueState("reserved", "at long, tokens long")
        self.settlements = handle.getListState("settlements", "at long, kind string, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = self.reserved.get() if self.reserved.exists() else None
        earliest = None
        for row in rows:
            if row.kind == "reserve":
                first = min(filter(None, (first, (row.at, row.tokens))))
            else:
                self.settlements.appendValue((row.at, row.kind, row.tokens))
                earliest = min(earliest or row.at, row.at)
        if first:
            self.reserved.update(tuple(first))
        # microseconds, but timers count milliseconds: rounded up, so that no event of the deadline's millisecond is missed
        due = -(-(first[0] if first else earliest) // 1000) + self.limit
        set_ = list(self.handle.listTimers())
        if not set_ or first and set_ != [due] or not first and min(set_) > due:
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first = self.reserved.get() if self.reserved.exists() else None
        told = list(self.settlements.get()) if self.settlements.exists() else []
        self.reserved.clear()
        self.settlements.clear()
        last = first[0] + self.limit * 1000 if first else None
        own = min(((at, kind == "fail", kind, n) for at, kind, n in told if not first or first[0] <= at <= last), default=None)
        kind, reported = own[2:] if own else (None, 0)
        status = "unreserved" if not first else "completed" if kind == "settle" else "failed"
        error = None if not first else "interrupted" if kind is None else "reported" if kind == "fail" else None
        held = first[1] if first else 0
        yield Row(ledger=key[0], id=key[1], status=status, error=error, reserved_tokens=held, accounted_tokens=reported if kind == "settle" else held, settlements=len(told))

    def close(self) -> None:
        pass


def settled(events: DataFrame, limit: timedelta, late: str) -> DataFrame:
    """The stream of outcomes of a stream of events, which may be late by `late`; a session sets ROCKSDB as its state store.

    A call is told when the watermark has passed its deadline; after an interruption the query goes on from its checkpoint,
    and calls that were open then are told like any other.
    """
    rows = _valid(events).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("ledger", "id").transformWithState(_Calls(limit), OUT, "append", "eventTime")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(ledger, id, tokens, ts): calls that a stopped stream's checkpoint holds open, through Spark's reader of states."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "reserved").load()
    return state.select("key.ledger", "key.id", F.col("value.tokens").alias("tokens"), F.timestamp_micros("value.at").alias("ts"))
