"""A usage ledger: calls reserve calls and tokens before they run and settle afterwards.

As a batch: the last status of each call and its accounted tokens.  As a stream: admission under caps, one key a
ledger, in order of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "calls long, tokens long"
OUT = "ledger string, id string, status string, accounted_tokens long, calls_used long, tokens_used long"


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return events.withColumn("latest_n", n).filter("latest_n = 1").drop("latest_n")


def counters(calls: DataFrame, *by: str) -> DataFrame:
    """Calls by status and tokens: a settled call counts what it reported, a failed or pending one what it reserved."""
    spent = F.when(F.col("status") == "completed", F.coalesce("reported_tokens", "reserved_tokens")).otherwise(F.col("reserved_tokens"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), count("completed"), count("failed"), count("pending"), F.sum(spent).alias("accounted_tokens"))


def admitted(requests: DataFrame, max_calls: int, max_tokens: int) -> DataFrame:
    """A stream (ledger, id, kind, tokens, seq): reserve is admitted while both caps hold; settle gives back the rest."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        calls, tokens = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["seq", "id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == "reserve":
                ok = calls + 1 <= max_calls and tokens + r.tokens <= max_tokens
                calls, tokens = (calls + 1, tokens + r.tokens) if ok else (calls, tokens)
                out.append((key[0], r.id, "pending" if ok else "refused", r.tokens if ok else 0, calls, tokens))
            else:  # tokens: what the call used less than it reserved, 0 for failures
                tokens -= r.tokens
                out.append((key[0], r.id, "completed" if r.kind == "settle" else "failed", -r.tokens, calls, tokens))
        state.update((calls, tokens))
        yield pd.DataFrame(out, columns=["ledger", "id", "status", "accounted_tokens", "calls_used", "tokens_used"])

    return requests.groupBy("ledger").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def resumed(batch: DataFrame, done_path: str, key: str) -> DataFrame:
    """Rows of a micro-batch whose key is not in the stored results, for foreachBatch."""
    spark = batch.sparkSession
    try:
        done = spark.read.parquet(done_path).select(key).distinct()
    except Exception as e:  # no result has been stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return batch
    return batch.join(done, key, "left_anti")


def repeated_failures(states: DataFrame) -> DataFrame:
    """(family, fingerprint): families whose last two attempts failed with the same fingerprint; they stop."""
    order = Window.partitionBy("family").orderBy("attempt")
    before = F.lag("fingerprint").over(order)
    last = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("attempt")))
    rows = states.withColumns({"before": before, "n": last})
    return rows.filter("n = 1 and status = 'needs_correction' and before = fingerprint").select("family", "fingerprint")


TRANSITIONS = {
    "pending": ("created", "paused", "error"),
    "created": ("needs_correction", "validated", "paused", "error"),
    "needs_correction": ("created", "validated", "paused", "error"),
    "paused": ("pending", "created", "needs_correction"),
}


def bad_transitions(states: DataFrame) -> DataFrame:
    """(family, attempt, before, status): steps of a family's life that are not allowed."""
    order = Window.partitionBy("family").orderBy("attempt")
    rows = states.withColumn("before", F.lag("status").over(order)).filter("before is not null")
    ok = F.lit(False)
    for state, after in TRANSITIONS.items():
        ok = ok | ((F.col("before") == state) & F.col("status").isin(*after))
    return rows.filter(~ok & (F.col("before") != F.col("status"))).select("family", "attempt", "before", "status")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts of a stream's events by type in tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
