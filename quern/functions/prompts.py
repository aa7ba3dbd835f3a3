"""Prompts for evaluated questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip

ORACLE_CONDITIONS = ("oracle_cot", "oracle_program_cot")
# The markers in brackets are what answers are read from; the wording may be replaced.
PROGRAM = (
    "[INSTRUCTIONS]:\nWork out this tax amount for {country} in {year}.\nWrite the law's arithmetic as Python in one ```python block and assign "
    'the result to `ans`.\nIf a needed fact is missing, assign ans = "insufficient information".'
)
STEPS = (
    "[INSTRUCTIONS]:\nWork out this tax amount for {country} in {year}.\nReason in steps, name the provisions and calculate exactly.\n"
    "End with one line: [FINAL ANSWER]: \\boxed{value} [UNIT]\nIf a needed fact is missing, end with: [FINAL ANSWER]: \\boxed{insufficient information}"
)


def citation_context(citations: Column) -> Column:
    """Gold passages of array<struct<citation_id, official_title, article_section, supporting_passage>> in order."""
    one = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.concat_ws(", ", c["official_title"], c["article_section"]), F.lit("\n"), c["supporting_passage"])
    return F.when(F.size(citations) > 0, F.concat(F.lit("[LEGAL SOURCES]:\n"), F.array_join(F.transform(citations, one), "\n\n")))


def passage_context(passages: Column) -> Column:
    """Retrieved passages of array<struct<rank, title, text>> by rank."""
    one = lambda p: F.concat(F.lit("["), p["rank"].cast("string"), F.lit("] "), F.coalesce(p["title"], F.lit("")), F.lit("\n"), p["text"])
    return F.when(F.size(passages) > 0, F.concat(F.lit("[RETRIEVED PASSAGES]:\n"), F.array_join(F.transform(F.array_sort(passages), one), "\n\n")))


def prompt(condition: Column, country: Column, year: Column, question: Column, citations: Column, passages: Column) -> Column:
    """Gold passages only for the oracle conditions, retrieved ones only where the condition's name has rag."""
    context = F.when(condition.isin(*ORACLE_CONDITIONS), citation_context(citations)).when(condition.contains("rag"), passage_context(passages))
    task = F.when(condition.contains("program_cot"), PROGRAM).otherwise(STEPS)
    task = F.replace(F.replace(task, F.lit("{country}"), F.coalesce(country, F.lit(""))), F.lit("{year}"), F.coalesce(year.cast("string"), F.lit("")))
    return F.concat_ws("\n\n", context, F.concat(F.lit("[QUESTION]:\n"), strip(F.coalesce(question, F.lit("")))), task)
