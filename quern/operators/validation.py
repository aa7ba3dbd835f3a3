"""Contracts of questions, citations, plans and reviews as tables of violations (rule, key, message)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import INSUFFICIENT, bind_quote, duplicate_signature, is_plain_decimal, normal, source_id, starts_formula, strip
from quern.tables import few, stored

# Fixed values of the data model.
CATEGORIES = ("1000", "2000", "3000", "4000", "5000", "6000")
TAXPAYERS = (
    "Individual", "Self-employed / sole proprietor", "Company / corporation", "Partnership", "Estate / trust",
    "Nonprofit / tax-exempt entity", "Other taxpayer",
)
VARIANTS = ("original", "numbers", "threshold", "eligibility", "temporal", "missing_information")
STATUSES = ("draft", "ready", "needs_correction", "validated")
DIFFICULTIES = ("D2", "D3", "D4")
UNITS = (
    "KZT", "INR", "PKR", "CNY", "IDR", "PLN", "EGP", "USD", "EUR", "percent", "percentage_points", "days", "months", "years",
    "L", "kg", "tonne", "m2", "count",
)


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key): one row for each rule that a row breaks; rules name conditions that hold for bad rows."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return rows.select(key.cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) == "", F.lit(False))


def question_rules() -> dict[str, Column]:
    """For columns of the question table."""
    missing = F.col("variant") == "missing_information"
    outside = lambda c, values: F.coalesce(~F.col(c).isin(*values), F.lit(True))
    texts = ("family", "country", "language", "year_period_target", "question", "final_answer_text", "note")
    return {
        "number": F.coalesce(F.col("no") < 1, F.lit(True)),
        "variant": outside("variant", VARIANTS),
        "category": outside("tax_category", CATEGORIES),
        "taxpayer": outside("primary_taxpayer", TAXPAYERS),
        "difficulty": outside("difficulty", DIFFICULTIES),
        "status": outside("status", STATUSES),
        "year": F.coalesce(~F.col("case_year").between(1, 9999), F.lit(True)),
        "blank": F.exists(F.array(*(_blank(c) for c in texts)), lambda x: x),
        "length": F.coalesce(F.char_length("question") > 40000, F.lit(False)),
        "answer": ~missing & ~F.coalesce(is_plain_decimal(F.col("answer_value")), F.lit(False)),
        "unit": ~missing & outside("unit", UNITS),
        "missing answer": missing & (F.col("answer_value").isNotNull() | F.coalesce(normal(F.col("final_answer_text")) != INSUFFICIENT, F.lit(True))),
    }


def citation_rules() -> dict[str, Column]:
    date = lambda c: F.col(c).isNotNull() & (~F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.expr(f"try_to_date({c}) is null"))
    return {
        "citation id": F.coalesce(~F.col("citation_id").rlike("^C[1-9][0-9]*$"), F.lit(True)),
        "passage": F.coalesce(strip(F.col("supporting_passage")) == "", F.lit(True)),
        "from": date("rule_applies_from"),
        "until": date("rule_applies_until"),
        "order": F.coalesce(F.col("rule_applies_until") < F.col("rule_applies_from"), F.lit(False)),
    }


def orphans(citations: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that refer to nothing."""
    return citations.join(questions.select(*keys).distinct(), keys, "left_anti")


def resolved_sources(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations with document_id: the document of the source id, else of the raw path if just one has it."""
    by_id = documents.select(F.col("id").alias("d_id"))
    by_path = documents.groupBy(F.col("raw_path").alias("d_path")).agg(F.count(F.lit(1)).alias("d_n"), F.min("id").alias("d_only"))
    rows = citations.withColumn("d_key", source_id(F.col("source_file")))
    rows = rows.join(by_id, F.col("d_key") == F.col("d_id"), "left").join(by_path, F.col("source_file") == F.col("d_path"), "left")
    found = F.coalesce("d_id", F.when(F.col("d_n") == 1, F.col("d_only")))
    issue = F.when(found.isNotNull(), None).when(F.col("d_n") > 1, "ambiguous").otherwise("unknown")
    return rows.select(*(F.col(f"`{c}`") for c in citations.columns), found.alias("document_id"), issue.alias("source_issue"))


def unknown_step_citations(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """(no, missing): citation ids that a question's steps name and it does not have, and steps without any."""
    has = citations.groupBy(F.col("question_no").alias("no")).agg(F.collect_set("citation_id").alias("has"))
    named = F.array_distinct(F.flatten(F.transform("gold_steps", lambda s: s["citations"])))
    empty = F.exists("gold_steps", lambda s: F.size(s["citations"]) < 1)
    rows = questions.join(has, "no", "left").withColumn("missing", F.array_except(named, F.coalesce("has", F.array().cast("array<string>"))))
    return rows.filter((F.size("missing") > 0) | empty).select("no", "missing", empty.alias("empty_step"))


def bound_passages(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations (question_no, citation_id, document_id, supporting_passage) with the source's own slice, or an issue."""
    rows = citations.join(documents.select(F.col("id").alias("document_id"), F.col("text").alias("source_text")), "document_id", "left")
    slice_ = bind_quote(F.col("supporting_passage"), F.col("source_text"))
    issue = F.when(F.col("source_text").isNull(), "no source").when(slice_.isNull(), "not found once")
    return rows.select("question_no", "citation_id", "document_id", slice_.alias("passage"), issue.alias("issue"))


#: Probes at most that one automaton holds; more raise ValueError.
PROBES = 1_000_000


def holding(documents: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, id): documents (id, text) whose text, in normal form, holds a probe (probe_id, probe) as it stands; empty ones never.

    The probes are few by their nature (gold passages) and checked to be: one automaton of them reads each text once.
    """
    rows = probes.select("probe_id", F.col("probe").alias("p")).filter("p <> ''").limit(PROBES + 1).collect()
    if len(rows) > PROBES:
        raise ValueError(f"more than {PROBES} probes")
    by_text: dict[str, list[int]] = {}
    for r in rows:
        by_text.setdefault(r["p"], []).append(r["probe_id"])
    shared = documents.sparkSession.sparkContext.broadcast(by_text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = automaton(shared.value)
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                for p in found_in(text or ""):
                    found += shared.value[p]
                    ids += [i] * len(shared.value[p])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("id").take(pa.array(ids, pa.int64()))], ["probe_id", "id"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", normal(F.col("text")).alias("t")).mapInArrow(search, f"probe_id long, id {kind}")


def automaton(words: Iterable[str]) -> Callable[[str], set[str]]:
    """A function that gives the words that a text holds."""
    words = list(words)
    try:
        import ahocorasick
    except ImportError:  # slower, with equal results
        return lambda text: {w for w in words if w in text}
    tree = ahocorasick.Automaton()
    for w in words:
        tree.add_word(w, w)
    if not words:
        return lambda text: set()
    tree.make_automaton()
    return lambda text: {w for _, w in tree.iter(text)}


def duplicate_questions(rows: DataFrame) -> DataFrame:
    """(family, no, first_family): questions whose text, but for case and white space, an earlier family has."""
    signed = stored(rows.select("family", "no", F.sha2(normal(F.col("question")), 256).alias("t")), "questions")
    firsts = signed.groupBy("t").agg(F.min("family").alias("first_family"), F.max("family").alias("last")).filter("first_family < last").drop("last")
    return signed.join(few(stored(firsts, "question-firsts")), "t").filter("first_family < family").select("family", "no", "first_family")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(family, no): questions of a family that equal an earlier one but for numbers; temporal variants may."""
    signed = rows.withColumn("signature", F.sha2(duplicate_signature(F.col("question"), F.col("steps")), 256))
    n = F.row_number().over(Window.partitionBy("family", "signature").orderBy("no"))
    return signed.withColumn("n", n).filter("n > 1 and variant <> 'temporal'").select("family", "no")


def first_rows(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key by position: de-duplication that keeps order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return rows.withColumn("dedup_n", n).filter("dedup_n = 1").drop("dedup_n")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new in place of those with their key, and new's other rows added; new has one row a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def review_failures(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """(no, issue): every question needs one passing review, by another than its author, that recomputes its answer.

    questions: no, answer_value, unit, author; reviews: question_no, reviewer, passed, recomputed_answer, unit.
    """
    r = reviews.groupBy(F.col("question_no").alias("no")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("passed").alias("passed"), F.min("recomputed_answer").alias("again"),
        F.min("unit").alias("review_unit"), F.collect_set("reviewer").alias("reviewers"),
    )
    rows = questions.join(r, "no", "full_outer")
    value = lambda c: F.col(c).try_cast("decimal(38,10)")
    issue = (
        F.when(F.col("author").isNull() & F.col("answer_value").isNull() & F.col("n").isNotNull(), "review of no question")
        .when(F.col("n").isNull(), "not reviewed")
        .when(F.col("n") > 1, "reviewed more than once")
        .when(F.array_contains("reviewers", F.col("author")), "own review")
        .when(~F.col("passed"), "not passed")
        .when(~F.coalesce(value("again") == value("answer_value"), F.lit(False)), "other answer")
        .when(~F.coalesce(F.lower("review_unit") == F.lower("unit"), F.lit(False)), "other unit")
    )
    return rows.select("no", issue.alias("issue")).filter("issue is not null")


def plan_failures(cases: DataFrame) -> DataFrame:
    """(question_no, issue) of planned cases: question_no, pos, variant, derived_from, legal_parameters."""
    parent = cases.select(F.col("question_no").alias("derived_from"), F.col("pos").alias("parent_pos"), F.col("variant").alias("parent_variant"))
    rows = cases.join(parent, "derived_from", "left").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("question_no")))
    regular = F.col("variant") != "missing_information"
    issue = (
        F.when(F.col("n") > 1, "number twice")
        .when((F.col("variant") == "original") & F.col("derived_from").isNotNull(), "original is derived")
        .when((F.col("variant") != "original") & F.col("parent_pos").isNull(), "no parent")
        .when(F.col("parent_pos") >= F.col("pos"), "parent comes later")
        .when(F.col("parent_variant") == "missing_information", "parent is not regular")
        .when(regular & (F.size("legal_parameters") < 1), "no legal parameter")
    )
    return rows.select("question_no", issue.alias("issue")).filter("issue is not null")


def temporal_pairs(questions: DataFrame) -> DataFrame:
    """(no, issue): a temporal variant must be its parent's template for another year.  no, variant, derived_from, template, case_year."""
    p = questions.select(F.col("no").alias("derived_from"), F.col("template").alias("parent_template"), F.col("case_year").alias("parent_year"))
    rows = questions.filter("variant = 'temporal'").join(p, "derived_from", "left")
    issue = F.when(F.col("parent_template").isNull(), "no parent").when(F.col("template") != F.col("parent_template"), "other template").when(F.col("case_year") == F.col("parent_year"), "same year")
    return rows.select("no", issue.alias("issue")).filter("issue is not null")


def formula_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.filter(starts_formula(*(F.col(c) for c in columns))).select(key)
