"""Reports over a run of dataset construction: what was asked for, made, exported and left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(assigned: DataFrame, states: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: families requested, created, validated, exported rows, and the unresolved families in order."""
    done = states.filter("status = 'validated'").select("family_id")
    left = assigned.select("family_id").distinct().join(done, "family_id", "left_anti")
    counts = states.agg(F.count_if(F.col("status") != "pending").alias("created"), F.count_if(F.col("status") == "validated").alias("validated"))
    asked = assigned.agg(F.count_distinct("family_id").alias("requested"))
    rows = exported.agg(F.count(F.lit(1)).alias("exported"))
    open_ = left.agg(F.array_sort(F.collect_list("family_id")).alias("unresolved"))
    return asked.crossJoin(counts).crossJoin(rows).crossJoin(open_).withColumn("complete", F.size("unresolved") == 0)


def countries(rollups: DataFrame) -> DataFrame:
    """One row over countries: complete if and only if all are."""
    return rollups.agg(F.count(F.lit(1)).alias("countries"), F.bool_and("complete").alias("complete"), F.sum("exported").alias("exported"))


def source_health(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """(kind, n): documents that are whole or partial, and failures by code."""
    whole = F.when(F.col("partial"), "partial").otherwise("whole")
    return documents.groupBy(whole.alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(failures.groupBy(F.col("code").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def cited_sources(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """(url, id, citations): distinct cited documents with the number of citations, for mirroring."""
    return citations.groupBy(F.col("official_source_url").alias("url")).agg(F.count(F.lit(1)).alias("citations")).join(documents.select("url", "id").distinct(), "url").select("url", "id", "citations")


def routed_feedback(issues: DataFrame, cases: DataFrame) -> DataFrame:
    """(question_no, issue): an issue that names 'Question N' goes to that case, any other to all cases."""
    n = F.regexp_extract("issue", r"^\s*Question (\d+)(?![0-9])", 1)
    rows = issues.select("issue", F.when(n != "", n.cast("int")).alias("question_no"))
    numbers = cases.select("question_no")
    named = rows.filter("question_no is not null").join(numbers, "question_no").select("question_no", "issue")
    # what names no question goes to each: the output itself is that large
    return named.unionByName(numbers.crossJoin(rows.filter("question_no is null").select("issue")))
