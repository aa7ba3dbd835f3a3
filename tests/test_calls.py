from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming import calls

LIMIT = timedelta(minutes=10)
SCHEMA = "ledger string, id string, kind string, tokens long, ts timestamp"
T = datetime(2024, 1, 1, 12)


def at(minutes):
    return T + timedelta(minutes=minutes)


EVENTS = [
    ("a", "1", "reserve", 100, at(0)), ("a", "1", "settle", 60, at(3)), ("a", "1", "settle", 70, at(4)),
    ("a", "2", "reserve", 50, at(1)), ("a", "2", "fail", None, at(5)),
    ("a", "3", "reserve", 40, at(2)),  # interrupted
    ("a", "4", "reserve", 30, at(2)), ("a", "4", "settle", 9, at(13)),  # after its deadline
    ("b", "1", "settle", 5, at(2)),  # never reserved
    ("b", "2", "settle", 7, at(3)), ("b", "2", "reserve", 20, at(2)),  # arrives before its reservation
    ("b", "3", "reserve", 8, at(0)), ("b", "3", "reserve", 99, at(1)), ("b", "3", "settle", 0, at(10)),  # on its deadline
    (None, "9", "reserve", 1, at(0)), ("b", "9", "other", 1, at(0)), ("b", "9", "reserve", 1, None),
]
WANT = {
    ("a", "1"): ("completed", None, 100, 60, 2), ("a", "2"): ("failed", "reported", 50, 50, 1), ("a", "3"): ("failed", "interrupted", 40, 40, 0),
    ("a", "4"): ("failed", "interrupted", 30, 30, 1), ("b", "1"): ("unreserved", None, 0, 5, 1), ("b", "2"): ("completed", None, 20, 7, 1),
    ("b", "3"): ("completed", None, 8, 0, 1),
}


def got(df):
    return {(r.ledger, r.id): (r.status, r.error, r.reserved_tokens, r.accounted_tokens, r.settlements) for r in df.collect()}


def test_outcomes_of_a_table(rows):
    assert got(calls.outcomes(rows(SCHEMA, *EVENTS), LIMIT)) == WANT
    assert calls.outcomes(rows(SCHEMA), LIMIT).count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, calls.ROCKSDB)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("turned", [False, True])
def test_interrupted_stream_goes_on_and_tells_open_calls(spark, rows, rocksdb, tmp_path, turned):
    """Two runs from one checkpoint: what the first leaves open is read from its state and told by timers in the second."""
    source, cp, out = (str(tmp_path / p) for p in ("in", "cp", "out"))
    first = [e for e in EVENTS if e[4] and e[4] <= at(4)]
    rest = [e for e in EVENTS if e not in first]

    def run(events):
        rows(SCHEMA, *events[:: -1 if turned else 1]).coalesce(1).write.mode("append").parquet(source)
        stream = calls.settled(spark.readStream.schema(SCHEMA).parquet(source), LIMIT, "5 minutes")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    run(first)
    told = spark.read.schema(calls.OUT).parquet(out)
    assert told.count() == 0
    open_ = {(r.ledger, r.id): (r.tokens, r.ts) for r in calls.pending(spark, cp).collect()}
    assert open_ == {("a", "1"): (100, at(0)), ("a", "2"): (50, at(1)), ("a", "3"): (40, at(2)), ("a", "4"): (30, at(2)), ("b", "2"): (20, at(2)), ("b", "3"): (8, at(0))}
    run([*rest, ("z", "z", "reserve", 1, at(60))])
    assert got(spark.read.schema(calls.OUT).parquet(out)) == WANT
    left = calls.pending(spark, cp).filter(F.col("ledger") != "z")
    assert left.count() == 0
