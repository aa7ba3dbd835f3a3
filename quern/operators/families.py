"""Checks of drafted families and runs as tables of failures, and small projections and counts over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import INSUFFICIENT, bind_quote, duplicate_signature, starts_formula
from quern.operators.validation import UNITS, resolved_sources

SUMMARY = "id title url country language kind edition_note partial extraction_gaps extraction_warnings sha256 text_sha256".split()
UNAVAILABLE = "[UNAVAILABLE PROVISION"


def _failed(rows: DataFrame, no: str, *rules: tuple[str, Column]) -> DataFrame:
    """(family, no, failure): a row for each rule that holds for a row."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)))
    return rows.select("family", F.col(no).cast("long").alias("no"), F.explode(broken).alias("failure"))


def bound_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations with their document (document_id, and its columns as d_...) and the slice of its text that they quote."""
    d = documents.select(F.col("id").alias("document_id"), *(F.col(c).alias(f"d_{c}") for c in ("country", "language", "kind", "text")))
    rows = resolved_sources(citations, documents).join(d, "document_id", "left")
    return rows.withColumn("slice", bind_quote(F.col("supporting_passage"), F.col("d_text")))


def family_failures(assigned: DataFrame, questions: DataFrame, citations: DataFrame, documents: DataFrame, periods: DataFrame, run: dict[str, str]) -> DataFrame:
    """(family, no, failure) of drafted families; no is null for what concerns a whole family.

    assigned: family, no.  questions: family, no, country, language, variant, case_year, status, note, question, unit,
    answer_value, gold_steps.  citations: family, question_no, language, citation_id, source_file, supporting_passage.
    documents: id, raw_path, country, language, kind, text.  periods: label, start, end.  run: country, language, currency.
    """
    # the assigned numbers exactly once, and one original
    n = questions.groupBy("family", "no").agg(F.count(F.lit(1)).alias("n"))
    both = assigned.withColumn("wanted", F.lit(True)).join(n, ["family", "no"], "full_outer")
    numbers = both.groupBy("family").agg(F.bool_or(F.col("wanted").isNull() | F.col("n").isNull()).alias("odd"), F.bool_or(F.col("n") > 1).alias("twice"))
    originals = questions.groupBy("family").agg(F.count_if(F.col("variant") == "original").alias("originals"))
    whole = numbers.join(originals, "family", "left").withColumn("no", F.lit(None).cast("long"))
    out = [_failed(whole, "no", ("assigned numbers", F.col("odd") | F.col("twice")), ("number twice", F.col("twice")), ("originals", F.coalesce("originals", F.lit(0)) != 1))]
    # citations
    keys = ["family", "question_no", "language"]
    same = citations.groupBy(*keys, "citation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out.append(_failed(same, "question_no", ("citation twice", F.lit(True))))
    known = questions.select("family", F.col("no").alias("question_no"), "language").distinct()
    out.append(_failed(citations.join(known, keys, "left_anti"), "question_no", ("citation of no question", F.lit(True))))
    c = bound_citations(citations, documents)
    found = F.col("document_id").isNotNull()
    out.append(
        _failed(
            c, "question_no",
            ("no single source", ~found),
            ("source of another country or language", found & ~(F.col("d_country").eqNullSafe(F.lit(run["country"])) & F.col("d_language").eqNullSafe(F.lit(run["language"])))),
            ("navigation page", found & (F.col("d_kind") == "navigation")),
            ("quote", found & F.col("slice").isNull()),
            ("unavailable provision", F.contains("slice", F.lit(UNAVAILABLE))),
        )
    )
    # questions
    has = citations.groupBy("family", F.col("question_no").alias("no"), "language").agg(F.collect_set("citation_id").alias("has"))
    q = questions.join(has, ["family", "no", "language"], "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    # a period for each year is few rows by the settings' own limits
    q = q.join(F.broadcast(periods.select("label", F.col("start").alias("p_start"), F.col("end").alias("p_end")).limit(1000)), F.col("case_year").between(F.col("p_start"), F.col("p_end")), "left")
    q = q.join(assigned.select("family", F.col("family").alias("assigned_family")).distinct(), "family", "left")
    last = F.element_at("gold_steps", -1)
    missing = F.col("variant") == "missing_information"
    number = lambda x: x.try_cast("decimal(38,10)")
    differs = F.when(missing, (last["result"] != INSUFFICIENT) | last["unit"].isNotNull()).otherwise(
        ~F.coalesce((number(last["result"]) == number(F.col("answer_value"))) & last["unit"].eqNullSafe(F.col("unit")), F.lit(False))
    )
    cited = F.array_distinct(F.flatten(F.transform("gold_steps", lambda s: s["citations"])))
    texts = [F.col(x) for x, t in questions.dtypes if t == "string"]
    out.append(
        _failed(
            q, "no",
            ("formula", starts_formula(*texts)),
            ("other assignment", ~same_assignment(F.col("family"), F.col("country"), F.col("language"), F.col("assigned_family"), run)),
            ("validated by its author", F.col("status") == "validated"),
            ("no note", (F.col("variant") != "original") & F.col("note").isNull()),
            ("no period", F.col("label").isNull()),
            ("unit", ~missing & ~F.coalesce(F.col("unit").isin(*UNITS, run.get("currency", "")), F.lit(False))),
            ("no citation", F.size("has") < 1),
            ("step cites what is missing", F.size(F.array_except(cited, "has")) > 0),
            ("last step", differs),
        )
    )
    step = lambda s: F.concat_ws(" ", s["step"], s["result"], F.coalesce(s["unit"], F.lit("")), F.array_join(s["citations"], ","))
    signed = q.filter("variant <> 'temporal'").select("family", "no", F.sha2(duplicate_signature(F.col("question"), F.array_join(F.transform("gold_steps", step), "\n")), 256).alias("signature"))
    first = signed.groupBy("family", "signature").agg(F.min("no").alias("first"))
    out.append(_failed(signed.join(first, ["family", "signature"]).filter("no > first"), "no", ("differs by numbers only", F.lit(True))))
    return reduce(DataFrame.unionByName, out).distinct()


def same_assignment(family: Column, country: Column, language: Column, assigned: Column, run: dict[str, str]) -> Column:
    """Whether family, country and language are those of the assignment."""
    return family.eqNullSafe(assigned) & country.eqNullSafe(F.lit(run["country"])) & language.eqNullSafe(F.lit(run["language"]))


def run_failures(questions: DataFrame, slots: DataFrame, families: DataFrame, templates: DataFrame, enabled: list[str]) -> DataFrame:
    """(family, no, failure) of a run: slots, saved templates and categories.

    questions: family, no, variant, case_year, year_period_target, tax_category, question, derived_from.  slots: family, no,
    label, start, end.  families: family, category, options (array), reallocation (its reason or null).  templates: family, no, template.
    """
    rows = questions.join(slots.withColumn("slot", F.lit(True)), ["family", "no"], "full_outer").join(templates, ["family", "no"], "left")
    parent = templates.select("family", F.col("no").alias("derived_from"), F.col("template").alias("parent_template"))
    rows = rows.join(parent, ["family", "derived_from"], "left")
    year = F.col("case_year").cast("string")
    holds = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit("{case_year}"))
    filled = lambda c: F.replace(F.col(c), F.lit("{case_year}"), year)
    temporal = F.col("variant") == "temporal"
    out = _failed(
        rows, "no",
        ("not the assigned cases", F.col("slot").isNull() | F.col("variant").isNull() | (F.col("variant") == "missing_information")),
        ("other slot", (F.col("year_period_target") != F.col("label")) | ~F.col("case_year").between(F.col("start"), F.col("end"))),
        ("template without year", F.col("template").isNotNull() & ~holds("template")),
        ("text is not its template", F.col("template").isNotNull() & (F.col("question") != filled("template"))),
        ("no shared template", temporal & F.col("parent_template").isNull()),
        ("counterpart changed", temporal & (F.col("question") != filled("parent_template"))),
    )
    own = questions.groupBy("family").agg(F.collect_set("tax_category").alias("own")).join(families, "family").withColumn("no", F.lit(None).cast("long"))
    on = F.array(*map(F.lit, enabled))
    whole = _failed(
        own, "no",
        ("one enabled category", (F.size("own") != 1) | (F.size(F.array_except("own", on)) > 0)),
        ("breaks temporal balance", F.size(F.array_except("own", F.coalesce("options", on))) > 0),
        ("category without reason", ~F.array_contains("own", F.col("category")) & F.col("reallocation").isNull()),
    )
    return out.unionByName(whole)


def inventory_summary(documents: DataFrame) -> DataFrame:
    """The twelve columns of SUMMARY (null where documents lack one) of what is no navigation."""
    return documents.filter(~F.col("kind").eqNullSafe(F.lit("navigation"))).select(*(F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY))


def topic_counts(topics: DataFrame, categories: list[str]) -> DataFrame:
    """(category, families): how many earlier topics each category has, also none."""
    labels = topics.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    n = topics.groupBy(F.col("tax_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("families"))


def settings_preview(assigned: DataFrame, slots: DataFrame) -> DataFrame:
    """(category, families, regular, missing, periods): what settings come to; periods is a map of label to questions.

    assigned: family, category, regular (array of numbers), missing (array of numbers); slots: family, label.
    """
    count = assigned.groupBy("category").agg(F.count(F.lit(1)).alias("families"), F.sum(F.size("regular")).alias("regular"), F.sum(F.size("missing")).alias("missing"))
    by = slots.join(assigned.select("family", "category"), "family").groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))
    periods = by.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("periods"))
    return count.join(periods, "category", "left")


def united(draft: DataFrame, extra: DataFrame) -> DataFrame:
    """All rows of both, by column name; a column that one lacks is null there."""
    return draft.unionByName(extra, allowMissingColumns=True)


def translated(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations with translated_text of the document of their url, and issue 'no translation' where there is none."""
    texts = documents.groupBy(F.col("url").alias("official_source_url")).agg(F.min("text").alias("translated_text"))
    rows = citations.join(texts, "official_source_url", "left")
    return rows.withColumn("issue", F.when(F.col("translated_text").isNull(), "no translation"))
