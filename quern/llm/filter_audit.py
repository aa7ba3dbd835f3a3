"""How filters of documents overlap: what each removes in every order, and its Shapley value.

Each document gets a mask of the filters it fails.  Spark counts masks by part; from these counts (32 a part at most) a
part's removal polynomial is formed: R(x) = sum over masks of n * (1 - product of (1 - x_i) over the mask's filters), a
multilinear polynomial whose value at a corner is the number of documents that those filters remove together.  Survivors,
removals, redundant and unique failures of all orders are corner values.  A filter's Shapley value is the integral
of its partial derivative along the diagonal, from exact fractions; times 120 it is what the filter removes, summed over all orders.

Filters (FILTERS): A under 200 words; B under half of the words distinct; C over 3 % capital letters A-Z; D one of #$%&*|;
E the text of a smaller doc_id again.

Defined results.  A null text is empty: it fails A, and E if an empty or null text has a smaller doc_id.  A null lang is the part
''.  A null doc_id is smaller than none and has no smaller one, and no label.  Rows of equal doc_id and text are not copies of each
other.  A doc_id that labels names several times has quality or toxic 1 if one of them says so.  Very long texts are read whole.
No documents: no rows.  Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import require, small, stored

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_WHITE = " \t\n\x0b\f\r"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    bare = F.btrim(text, F.lit(_WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(c: Column) -> Column:
        fails = [c["n"] < 200, 100 * c["different"] < 50 * c["n"], 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))

    return F.transform(F.array(counted), bits)[0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just those filters.

    The texts never leave their task.  A copy is known without a join: of each text's rows those of its smallest doc_id are no
    copies, so the counts of these are taken from the counts of all.
    """
    text = F.coalesce("text", F.lit(""))
    rows = require(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    own = require(labels, "doc_id", "quality", "toxic").filter(F.col("doc_id").isNotNull())
    flags = (F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic"))
    said = small(stored(own.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(*flags), "labels"))
    # rows of one doc_id and text are one row from here on, with their number by part
    each = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    known = each.filter("doc_id is not null").join(said, "doc_id", "left")
    known = known.select(*each.columns, *(F.coalesce(F.col(c) * F.col("n"), zero).alias(a) for c, a in (("quality", "good"), ("toxic", "bad"))))
    known = known.unionByName(each.filter("doc_id is null").select("*", zero.alias("good"), zero.alias("bad")))
    each = stored(known, "masks")
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    every = each.groupBy("part", "mask").agg(*counts)
    grouped = each.filter("doc_id is not null").groupBy("digest", "doc_id", "mask").agg(F.collect_list(F.struct("part", "n", "good", "bad")).alias("rows"))
    first = grouped.groupBy("digest", "mask").agg(F.min_by("rows", "doc_id").alias("rows")).select("mask", F.inline("rows"))
    alone = each.filter("doc_id is null").select("mask", "part", "n", "good", "bad")
    kept = first.unionByName(alone).groupBy("part", "mask").agg(*counts)
    copies = every.select("part", (F.col("mask") + (1 << 4)).alias("mask"), "n", "good", "bad")
    less = kept.select("part", (F.col("mask") + (1 << 4)).alias("mask"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"), (-F.col("bad")).alias("bad"))
    return copies.unionByName(less).unionByName(kept).groupBy("part", "mask").agg(*counts).filter("n > 0").withColumnRenamed("bad", "toxic")


class Removal:
    """The removal polynomial of counts by mask: coefficient of each product of filters' variables."""

    def __init__(self, counts: dict[int, int]) -> None:
        above = [sum(n for m, n in counts.items() if m & s == s) for s in range(_ALL + 1)]
        self.coefficient = [0, *((-1) ** (s.bit_count() + 1) * above[s] for s in range(1, _ALL + 1))]
        self.corner = [sum(self.coefficient[s] for s in range(_ALL + 1) if s & t == s) for t in range(_ALL + 1)]

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by x_i at (t, ..., t)."""
        terms = [Fraction(0)] * len(FILTERS)  # by power of t
        for s, c in enumerate(self.coefficient):
            if s >> i & 1:
                terms[s.bit_count() - 1] += c
        return sum((c / (k + 1) for k, c in enumerate(terms)), Fraction(0))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders(part: str, counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The rows of one part: counts are (mask, n, good, toxic)."""
    size = sum(c[1] for c in counts)
    gone, good, toxic = (Removal({c[0]: c[k] for c in counts}) for k in (1, 2, 3))
    value = [gone.shapley(i) * 120 for i in range(len(FILTERS))]
    out = []
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after, own = before | 1 << i, 1 << i
            removed = gone.corner[after] - gone.corner[before]
            unique = gone.corner[_ALL] - gone.corner[_ALL ^ own]
            lost = [p.corner[after] - p.corner[before] for p in (good, toxic)]
            out.append((part, name, step, size - gone.corner[after], removed, gone.corner[own] - removed, unique, *lost, int(value[i])))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    parts = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"]):
                yield pd.DataFrame(orders(part, [(c["mask"], c["n"], c["good"], c["toxic"]) for c in counts]), columns=names)

    return parts.mapInPandas(of, SCHEMA)
