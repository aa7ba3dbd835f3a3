"""Accuracy, abstention and consistency of evaluated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import INSUFFICIENT, exact_match, strip, tolerant_match


def scored(records: DataFrame) -> DataFrame:
    """records with exact, tolerant, solvable and abstained, from gold_answer and pred_value."""
    gold, pred = F.col("gold_answer"), F.col("pred_value")
    says = lambda c: F.coalesce(F.lower(strip(c)) == INSUFFICIENT, F.lit(False))
    return records.withColumns(
        {"exact": exact_match(pred, gold), "tolerant": tolerant_match(pred, gold), "solvable": ~says(gold), "abstained": says(pred)}
    )


def _share(hit: Column, of: Column) -> Column:
    """Hits among those rows; 0 where there are none."""
    return F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))


def overall(rows: DataFrame, *by: str) -> DataFrame:
    """Totals and accuracies of scored rows, in one pass; by: columns such as condition."""
    every, s = F.lit(True), F.col("solvable")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s).alias("solvable_total"),
        _share(F.col("exact"), every).alias("em"),
        _share(F.col("tolerant"), every).alias("tolerant_em"),
        _share(F.col("exact"), s).alias("solvable_em"),
        _share(F.col("tolerant"), s).alias("solvable_tolerant"),
        _share(F.col("abstained"), ~s).alias("abstention_accuracy"),
        _share(F.col("abstained"), s).alias("false_abstention_rate"),
    )


def family_consistency(rows: DataFrame) -> DataFrame:
    """One row: families with a solvable row, all of which are exact, among all families."""
    each = rows.groupBy("family").agg(F.count_if("solvable").alias("n"), F.count_if(F.col("solvable") & ~F.col("exact")).alias("bad"))
    return each.agg(F.count(F.lit(1)).alias("families"), F.count_if((F.col("n") > 0) & (F.col("bad") == 0)).alias("consistent"))


def by_period(rows: DataFrame) -> DataFrame:
    """Per year_period_target: rows, solvable ones, and accuracy over the solvable."""
    return rows.groupBy("year_period_target").agg(F.count(F.lit(1)).alias("total"), F.count_if("solvable").alias("solvable"), _share(F.col("exact"), F.col("solvable")).alias("em"))


def by_variant(rows: DataFrame) -> DataFrame:
    """Per variant: rows, and accuracy over all of them."""
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("total"), _share(F.col("exact"), F.lit(True)).alias("em"))


def retrieval_means(hits: DataFrame) -> DataFrame:
    """Means over the queries that have retrieval metrics."""
    names = ("passage_recall", "complete", "source_recall", "reciprocal_rank")
    return hits.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def confusion(rows: DataFrame) -> DataFrame:
    """Macro F1 of answering against abstaining, with the four counts."""
    a, s = F.col("abstained"), F.col("solvable")
    out = rows.agg(F.count_if(a & ~s).alias("tp"), F.count_if(a & s).alias("fp"), F.count_if(~a & ~s).alias("fn"), F.count_if(~a & s).alias("tn"))
    f1 = lambda t, x, y: F.coalesce(2.0 * F.col(t) / F.nullif(2 * F.col(t) + F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    return out.withColumn("macro_f1", (f1("tp", "fp", "fn") + f1("tn", "fp", "fn")) / 2)


def with_period(rows: DataFrame, periods: DataFrame, year: str = "case_year") -> DataFrame:
    """rows with the first period (label, start, end, pos) that holds their year; periods are a table of settings."""
    if periods.count() > 1000:
        raise ValueError("periods are a small table of settings")
    p = [r.asDict() for r in periods.orderBy("pos").collect()]
    label = F.lit(None).cast("string")
    for r in reversed(p):
        label = F.when(F.col(year).between(r["start"], r["end"]), r["label"]).otherwise(label)
    return rows.withColumn("year_period_target", label)


def paired_years(records: DataFrame) -> DataFrame:
    """(family, question_no, case_year, before_no, gap, exact, before_exact): each answer of a family with its latest of an earlier year.

    An as-of match within the family by a window over (year, number): equal years have the same earlier one.
    """
    # a year's last number stands for it
    years = records.groupBy("family", "case_year").agg(F.max(F.struct("question_no", "exact")).alias("last"))
    before = F.lag(F.struct("case_year", "last.question_no", "last.exact")).over(Window.partitionBy("family").orderBy("case_year"))
    earlier = years.select("family", "case_year", before.alias("b")).filter("b is not null")
    rows = records.join(earlier, ["family", "case_year"])
    return rows.select("family", "question_no", "case_year", F.col("b.question_no").alias("before_no"), (F.col("case_year") - F.col("b.case_year")).alias("gap"), "exact", F.col("b.exact").alias("before_exact"))


def temporal_decay(records: DataFrame, now: int) -> DataFrame:
    """(tax_category, n, em, slope, intercept): accuracy by the years that a case lies back, and its least-squares line; slope is null for one year."""
    age, hit = (F.lit(now) - F.col("case_year")).cast("double"), F.col("exact").cast("double")
    line = [F.round(f(hit, age), 6).alias(n) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "intercept"))]
    return records.groupBy("tax_category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("em"), *line)


def paired_consistency(pairs: DataFrame) -> DataFrame:
    """(gap, pairs, both, lost, won, kept): by years between, pairs that are right both times, only before or only after, and the share
    of right ones that stay right."""
    now, was = F.col("exact"), F.col("before_exact")
    out = pairs.groupBy("gap").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(now & was).alias("both"), F.count_if(was & ~now).alias("lost"), F.count_if(now & ~was).alias("won"))
    return out.withColumn("kept", F.round(F.when(F.col("both") + F.col("lost") > 0, F.col("both") / (F.col("both") + F.col("lost"))), 6))


def error_kind(gold: Column, predicted: Column, unit_ok: Column, found: Column, abstention: str) -> Column:
    """One kind for each answer, the first that holds: right, false abstention, missed abstention, no answer, wrong unit, evidence
    not found, rounding (within a thousandth), factor (ten, hundred or thousand times), other value."""
    g, p = gold.try_cast("double"), predicted.try_cast("double")
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.abs(y) * 1e-3, F.lit(1e-9))
    factor = F.exists(F.array(*map(F.lit, (10.0, 100.0, 1000.0))), lambda f: near(p, g * f) | near(p * f, g))
    false = F.lit(False)
    return (
        F.when((gold == abstention) & F.coalesce(predicted == abstention, false), "right")
        .when(gold == abstention, "missed abstention")
        .when(F.coalesce(predicted == abstention, false), "false abstention")
        .when(predicted.isNull() | (F.trim(predicted) == ""), "no answer")
        .when(F.coalesce(F.abs(p - g) <= 0.01, predicted == gold), F.when(F.coalesce(unit_ok, false), "right").otherwise("wrong unit"))
        .when(~F.coalesce(found, false), "evidence not found")
        .when(F.coalesce(near(p, g), false), "rounding")
        .when(F.coalesce(factor, false), "factor")
        .otherwise("other value")
    )
