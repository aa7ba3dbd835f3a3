"""Quotas: largest-remainder shares, category and period slots, assignments, splits and coverage."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def apportioned(groups: DataFrame, total_of: DataFrame) -> DataFrame:
    """(grp, item, share): a total split by weight, remainders to the largest fractions, ties to the earlier item.

    groups: grp, pos, item, weight (whole number); total_of: grp, total.  All in whole numbers, so exact.
    """
    by = Window.partitionBy("grp")
    rows = groups.join(total_of, "grp").withColumn("sum", F.sum("weight").over(by))
    product = F.col("total").cast("decimal(38,0)") * F.col("weight").cast("decimal(18,0)")
    rows = rows.withColumns({"base": F.expr("cast(total as decimal(38,0)) * cast(weight as decimal(18,0)) div sum"), "rest": product % F.col("sum")})
    rows = rows.withColumn("n", F.row_number().over(by.orderBy(F.desc("rest"), "pos"))).withColumn("left", F.col("total") - F.sum("base").over(by))
    return rows.select("grp", "item", (F.col("base") + (F.col("n") <= F.col("left")).cast("int")).cast("long").alias("share"))


def shares(total: int, weights: list[int | float | Fraction]) -> list[int]:
    """The same for one list of settings."""
    exact = [Fraction(str(w)) for w in weights]
    whole = sum(exact)
    if total < 0 or whole <= 0 or any(w < 0 for w in exact):
        raise ValueError("a total and weights of at least 0, not all 0, are needed")
    out = [total * w // whole for w in exact]
    order = sorted(range(len(exact)), key=lambda i: (-(total * exact[i] / whole - out[i]), i))
    for i in order[: total - sum(out)]:
        out[i] += 1
    return [int(x) for x in out]


def category_slots(categories: list[tuple[str, float]], families: int) -> list[str]:
    """A category for each family: counts by share, dealt in turns so that every category comes early."""
    counts = shares(families, [w for _, w in categories])
    turns = [(turn, i) for i, n in enumerate(counts) for turn in range(n)]
    return [categories[i][0] for _, i in sorted(turns)]


def period_slots(periods: list[tuple[str, float]], families: int, per_family: int) -> list[list[str]]:
    """Periods of each family's questions: exact totals, each family with as many different ones as the totals allow.

    Families are filled one after the other with the periods of which most is left, first one of each.
    """
    left = shares(families * per_family, [w for _, w in periods])
    if any(w > 0 and n == 0 for (_, w), n in zip(periods, left)):
        raise ValueError("too few questions for every period")
    out = []
    for f in range(families):
        own: list[int] = []
        todo = families - f
        for i in range(len(left)):  # what later families could no longer take must go here
            own += [i] * max(0, left[i] - (todo - 1) * per_family)
        while len(own) < per_family:
            fair = lambda i: Fraction(left[i] - own.count(i) * todo, 1)
            fresh = [i for i in range(len(left)) if i not in own and left[i] > 0]
            some = fresh or [i for i in range(len(left)) if left[i] - own.count(i) > 0]
            own.append(max(some, key=lambda i: (fair(i), -i)))
        for i in own:
            left[i] -= 1
        out.append([periods[i][0] for i in own])
    return out


def assignments(spark: SparkSession, letter: str, categories: list[tuple[str, float]], periods: list[tuple[str, float]], families: int, regular: int, missing: int) -> DataFrame:
    """(family_id, category, question_no, is_missing, period): ids A-F01 on, question numbers without gaps."""
    cats, slots = category_slots(categories, families), period_slots(periods, families, regular)
    order = [p for p, _ in periods]
    rows = []
    for f in range(families):
        first = f * (regular + missing) + 1
        own = slots[f] + sorted(slots[f], key=order.index)[:missing]
        rows += [(f"{letter}-F{f + 1:02d}", cats[f], first + i, i >= regular, own[i] if i < len(own) else order[0]) for i in range(regular + missing)]
    return spark.createDataFrame(rows, "family_id string, category string, question_no int, is_missing boolean, period string")


def balanced_families(rows: DataFrame, target: int) -> DataFrame:
    """(family, picked): one family of each category in order of category, then further ones in turns, up to the target.

    rows: pos, family, category.  A family counts where it is first seen.
    """
    first = rows.groupBy("category", "family").agg(F.min("pos").alias("pos"))
    home = first.groupBy("family").agg(F.min_by("category", F.struct("pos", "category")).alias("category"), F.min("pos").alias("pos"))
    turn = home.withColumn("turn", F.row_number().over(Window.partitionBy("category").orderBy("pos", "family")))
    picked = turn.orderBy("turn", "category").limit(target).select("family", F.lit(True).alias("picked"))
    return home.select("family").join(picked, "family", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


def split(rows: DataFrame, target: int, part: str) -> DataFrame:
    """Rows of the dev families, or of all others (test), or all (full)."""
    if part in ("full", "all"):
        return rows
    if part not in ("dev", "test"):
        raise ValueError(f"unknown split: {part}")
    dev = balanced_families(rows, target).filter("picked")
    return rows.join(dev.select("family"), "family", "left_semi" if part == "dev" else "left_anti")


def coverage(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, period, regular, missing, target, issue) of questions against targets (category, period, target)."""
    n = questions.groupBy("category", "period").agg(F.count_if(~F.col("is_missing")).alias("regular"), F.count_if("is_missing").alias("missing"))
    out = n.join(targets, ["category", "period"], "full_outer").fillna(0, ["regular", "missing", "target"])
    issue = F.when(F.col("regular") < F.col("target"), "too few").when(F.col("regular") > F.col("target"), "too many")
    return out.select("category", "period", "regular", "missing", "target", issue.alias("issue"))


def category_options(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, feasible): whether one more family of a category keeps every count within 1 of its target.

    used: category, n; targets: category, target.  Both are tables of settings.
    """
    now = targets.join(used, "category", "left").fillna(0, ["n"])
    over = now.agg(F.count_if(F.abs(F.col("n") - F.col("target")) > 1).alias("bad"))
    own = F.abs(F.col("n") - F.col("target")) > 1
    after = F.abs(F.col("n") + 1 - F.col("target")) > 1
    return now.crossJoin(F.broadcast(over)).select("category", (F.col("bad") - own.cast("int") + after.cast("int") == 0).alias("feasible"))


def overlapping_periods(periods: DataFrame) -> DataFrame:
    """Pairs of labels of a settings table (label, start, end) whose inclusive years overlap; valid settings have none."""
    order = Window.orderBy("start", "end", "label")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return periods.withColumn("before", seen).filter("before >= start or start > end").select("label", "start", "end")
