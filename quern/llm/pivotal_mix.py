"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target size; its rate is target / size of the source, and a document's expected copies are the
rate.  The whole part is taken as it is.  The fractional parts are rounded by pairing: of two documents with open
fractions p, q and sizes a, b, mass moves from one to the other, at random in either direction and so that each
keeps its expectation and a*p + b*q stays the same, until one fraction is 0 or 1.  So what a source takes differs
from its target by less than its largest document at the end.

Documents are dealt by a hash to groups of about GROUP within their source and each group leaves at most one open
document; those are dealt to larger groups again, as a reduction tree, until a source has one group.  Its last
open document is rounded by chance, which may leave the source off its target by a share of that document.  Such a rest is
filled from small documents: a random pool of about FILL times the rest in words (all documents of a small source) gives or takes
single copies, the longest that fit first, so that the source misses its target by less than half its shortest document that can
still change.  No document is taken over `most` times.  Random numbers are hashes of seed, tree level and document, so reruns agree.

Repeated rows are dealt by doc_id, size and text, so one doc_id may have many rows.  The driver computes the targets of at
most SOURCES sources; more raise ValueError.

Defined results.  Very long texts are counted whole.  A null text has size 0; documents of size 0 are never taken, whatever their rate.
A null source is a source of its own, last in order.  Repeated rows are separate documents and may differ in
copies; which of two equal rows gets which is arbitrary and makes no difference.  An empty table gives an empty
result; sources without words have target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import require, stored

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Documents in a group of the first level, and groups joined at each further level.
GROUP = 256
#: Words of the pool that fills a rest, as a multiple of the rest, and its documents at least (in the mean).
FILL, POOL = 8, 256
#: Documents longer than a rest that are tried.
TRIED = 16
#: Sources at most: the driver sees a row of each.
SOURCES = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_RATE) -> dict[str | None, float]:
    """Target of each source: all sizes shared by weight, at most `most` times its own, the excess shared anew."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    total, full = sum(size.values()), set()
    while True:
        open_ = [s for s in size if s not in full]
        left = total - sum(most * size[s] for s in full)
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > most * size[s] * share]
        if not over:
            return {s: float(most * size[s]) if s in full else left * weight[s] / share for s in size}
        full.update(over)


def _chance(seed: int, level: int, *keys: str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *keys), 11) / F.lit(float(1 << 53))


def _pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by source, group: every row settled (p is 0 or 1) but for at most one open row a group."""
    held = None  # the group's open row: [its values, p]
    for rows in batches:
        out: list[tuple] = []
        for row in rows.itertuples(index=False):
            if held is not None and (row.source_no, row.grp) != (held[0].source_no, held[0].grp):
                out.append((*held[0][:-2], held[1], held[0].chance))
                held = None
            p, size = row.p, row.size
            if p <= 0 or p >= 1 or size == 0:
                out.append(tuple(row))
                continue
            if held is None:
                held = [row, p]
                continue
            q, other = held[1], held[0].size
            # mass, in words, that can move from this row to the held one, and back
            up, down = min(size * p, other * (1 - q)), min(size * (1 - p), other * q)
            move = up if row.chance * (up + down) < down else -down
            p, q = p - move / size, q + move / other
            if move == up:
                p, q = (0.0, q) if size * row.p <= other * (1 - held[1]) else (p, 1.0)
            else:
                p, q = (1.0, q) if size * (1 - row.p) <= other * held[1] else (p, 0.0)
            if 0 < p < 1:
                out.append((*held[0][:-2], q, held[0].chance))
                held = [row, p]
            else:
                out.append((*row[:-2], p, row.chance))
                if not 0 < q < 1:
                    out.append((*held[0][:-2], q, held[0].chance))
                    held = None
                else:
                    held = [held[0], q]
        yield pd.DataFrame(out, columns=rows.columns).astype(rows.dtypes.to_dict()) if out else rows.iloc[:0]
    if held is not None:
        yield pd.DataFrame([(*held[0][:-2], held[1], held[0].chance)], columns=rows.columns).astype(rows.dtypes.to_dict())


def _filled(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """A source's pool with copies given (rest > 0) or taken until the rest is as small as single copies make it.

    If none fits, one that is too long may be changed first and the others fill what it opens; the best of TRIED such is taken.
    """
    rows = rows.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
    size, start = rows["size"].to_numpy(), rows["copies"].to_numpy()

    def filled(copies: np.ndarray, rest: float) -> tuple[float, np.ndarray]:
        while True:  # each change brings the rest nearer to 0
            step, before = (1 if rest > 0 else -1), rest
            able = lambda: copies < most if step > 0 else copies > 0  # noqa: B023, E731
            for i in np.flatnonzero(able() & (size <= abs(rest))):
                if size[i] <= abs(rest):
                    copies[i] += step
                    rest -= step * size[i]
            if rest != before:
                continue
            over = np.flatnonzero(able() & (size < 2 * abs(rest)))  # the shortest of those that are more than fits
            if not len(over):
                return abs(rest), copies
            copies[over[-1]] += step
            rest -= step * size[over[-1]]

    rest = float(rows["rest"].iloc[0])
    step = 1 if rest > 0 else -1
    best = filled(start.copy(), rest)
    able = np.flatnonzero((start < most if step > 0 else start > 0) & (size > abs(rest)))
    for i in able[np.unique(size[able], return_index=True)[1]][:TRIED] if best[0] >= 1 else ():
        other = start.copy()
        other[i] += step
        best = min(best, filled(other, rest - step * size[i]), key=lambda x: x[0])
    return rows.assign(copies=best[1])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_RATE, seed: int = 7, group: int = GROUP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, *carry): how often each document is taken; carry names columns that come along."""
    spark = docs.sparkSession
    rows = require(docs, *dict.fromkeys(["doc_id", "text", "source", *carry]))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    kept = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    sized = stored(rows.select("doc_id", "source", size, F.xxhash64("text").alias("own"), *kept), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goal = targets([(r["source"], r["size"]) for r in found], weights, most)
    plan = spark.createDataFrame(
        [(i, r["source"], r["size"], goal[r["source"]], goal[r["source"]] / r["size"] if r["size"] else 0.0, -(-r["n"] // group)) for i, r in enumerate(found)],
        "source_no int, source string, source_size long, target double, rate double, groups long",
    )
    # one row for each source
    open_ = sized.join(F.broadcast(plan.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.floor("rate")
    open_ = open_.select("*", copies.alias("whole"), (F.col("rate") - copies).alias("p"))
    settled = None
    level, most_groups = 0, max([-(-r["n"] // group) for r in found], default=1)
    keys = ["doc_id", "size", "own"]
    named = [f"carry{i}" for i in range(len(carry))]
    while True:
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *keys), F.ceil(F.col("groups") / F.lit(group**level))).alias("grp")
        dealt = open_.select("source_no", slot, *named, "own", "doc_id", "source", "size", "source_size", "target", "rate", "groups", "whole", "p", _chance(seed, level + 100, *keys).alias("chance"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(n, "source_no", "grp").sortWithinPartitions("source_no", "grp", *keys)
        done = stored(dealt.mapInPandas(_pivot, dealt.schema), "mix-level").drop("chance", "grp")
        is_open = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
        last = most_groups <= group**level
        part = done if last else done.filter(~is_open)
        settled = part if settled is None else settled.unionByName(part)
        if last:
            break
        open_, level = done.filter(is_open), level + 1
    luck = F.when(F.col("p") >= 1, 1).when(F.col("p") <= 0, 0).when(_chance(seed, -1, "doc_id", "source") < F.col("p"), 1).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("whole") + luck).otherwise(0).cast("long").alias("copies")
    chosen = settled.select("source_no", "doc_id", "source", "size", "source_size", "target", taken, *named, _chance(seed, -2, *keys).alias("draw"))
    # one row for each source: what it lacks, and the share of its documents that may fill that
    free = F.when(F.col("rest") > 0, F.col("more")).otherwise(F.col("less"))
    own = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    sums = chosen.groupBy("source_no").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"), own(F.col("copies") < most).alias("more"), own(F.col("copies") > 0).alias("less"), F.count(F.lit(1)).alias("n"))
    rests = stored(sums.select(F.col("source_no").alias("no"), "rest", F.greatest(FILL * F.abs("rest") / F.greatest(free, F.lit(1)), F.lit(POOL) / F.col("n")).alias("share")), "mix-rests")
    joined = chosen.join(F.broadcast(rests), F.col("source_no") == F.col("no"), "left").drop("no")
    pool = F.coalesce((F.col("size") > 0) & (F.abs("rest") >= 0.5) & (F.col("draw") < F.col("share")), F.lit(False))
    inside = joined.filter(pool).drop("share")
    done = inside.groupBy("source_no").applyInPandas(lambda rows: _filled(rows, most), inside.schema)
    result = joined.filter(~pool).drop("share").unionByName(done)
    return result.select("doc_id", "source", "size", "source_size", "target", "copies", *(F.col(n).alias(c) for n, c in zip(named, carry)))
