"""Years of laws: when a document took effect, its latest snapshot, and a weight for a case's year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import years

# Fixed values.
CODE_TITLES = ("налоговый кодекс", "салық кодексі", "income tax ordinance", "income-tax act")
BUDGET_TITLES = ("бюджет", "finance act")
NEXT_YEAR_TITLES = ("налоговый кодекс", "салық кодексі", "о введении")
JULY_2025_TITLES = ("18 июля 2025", "18 шілде")


def _has(title: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(title), p))


def metadata(docs: DataFrame) -> DataFrame:
    """(id, title, y_eff, y_snap, is_code, is_budget) from columns id, title, raw_path."""
    title = F.coalesce("title", F.lit(""))
    in_title, every = years(title), F.concat(years(title), years(F.coalesce("raw_path", F.lit(""))))
    enacted = F.coalesce(F.array_min(in_title), F.array_min(every))
    effective = (
        F.when(enacted.isin(2008, 2017) & _has(title, NEXT_YEAR_TITLES), enacted + 1)
        .when((enacted == 2025) & _has(title, JULY_2025_TITLES), 2026)
        .otherwise(enacted)
    )
    return docs.select(
        "id", title.alias("title"), effective.alias("y_eff"), F.coalesce(F.array_max(every), effective).alias("y_snap"),
        _has(title, CODE_TITLES).alias("is_code"), _has(title, BUDGET_TITLES).alias("is_budget"),
    )


def multiplier(y_eff: Column, y_snap: Column, is_code: Column, is_budget: Column, case_year: Column, code_years: Column) -> Column:
    """Weight of a document for a case: none before it took effect, more for the code or budget then in force.

    code_years: array of the years in which a code took effect.
    """
    snap = F.coalesce(y_snap, y_eff)
    active = F.coalesce(F.array_max(F.filter(code_years, lambda y: y <= case_year)), y_eff)
    code = F.when(y_eff < active, 0.10).when(F.abs(y_snap - case_year) <= 2, 2.5).otherwise(2.0)
    budget = F.when((case_year >= y_eff) & (case_year <= snap + 1), 2.4).otherwise(0.10)
    other = F.lit(1.5) / (1.0 + 0.08 * F.greatest(F.lit(0), case_year - snap))
    return (
        F.when(case_year.isNull() | (case_year == 0), 1.0)
        .when(y_eff.isNull(), 0.6)
        .when(y_eff > case_year, 0.05)
        .when(is_code, code)
        .when(is_budget, budget)
        .otherwise(other)
    )
