"""Two runs over the same keys set beside each other, and what of them is equal, changed, added or gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("equal", "changed", "only_left", "only_right")


def _digested(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, digest, n): a key with its rows' digests added up, whatever their order; null keys are keys."""
    digest = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns), *(F.col(c).isNull() for c in columns))
    other = F.xxhash64(F.lit(1), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns), *(F.col(c).isNull() for c in columns))
    exact = F.sum(digest.cast("decimal(20,0)")).alias("a"), F.sum(other.cast("decimal(20,0)")).alias("b")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *exact)


def compared(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, state, n_left, n_right) for every key of either table: equal if its rows agree in columns as multisets.

    Both are pre-aggregated by key and meet in one full outer join of digests (two 64-bit sums); no row but these is shuffled.
    """
    a = _digested(left, keys, columns).select(*(F.col(k).alias(f"l_{k}") for k in keys), F.col("n").alias("n_left"), F.struct("n", "a", "b").alias("x"))
    b = _digested(right, keys, columns).select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col("n").alias("n_right"), F.struct("n", "a", "b").alias("y"))
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    state = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").when(F.col("x") == F.col("y"), "equal").otherwise("changed")
    key = [F.when(F.col("x").isNull(), F.col(f"r_{k}")).otherwise(F.col(f"l_{k}")).alias(k) for k in keys]
    return a.join(b, same, "full_outer").select(*key, state.alias("state"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def summary(states: DataFrame, groups: list[str], expected: DataFrame | None = None) -> DataFrame:
    """(groups, state, keys): counts by group and state, by group, by state and in all, in one pass of GROUPING SETS.

    A total has null in place of what it sums over; grouping_id says which.  Groups of expected without a key get a row of state 'absent'.
    """
    names = [*groups, "state"]
    sets = [names, groups, ["state"], []]
    out = states.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in names)).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("keys"))
    if expected is None:
        return out
    absent = expected.select(*groups).distinct().join(states.select(*groups).distinct(), groups, "left_anti")
    return out.unionByName(absent.select(*groups, F.lit("absent").alias("state"), F.lit(0).cast(out.schema["level"].dataType).alias("level"), F.lit(0).cast("long").alias("keys")))
