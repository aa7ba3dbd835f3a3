"""Search in the lines of documents, reading of lines and sections, and evidence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import quoted
from quern.operators import positional
from quern.operators.chunks import lines, section_spans
from quern.tables import stored

HITS, BUDGET, SECTIONS, MOST_LINES, MOST_CHARS = 6, 10_000, 40, 400, 40_000


def query_patterns(query: str) -> list[str]:
    """A pattern for each term: whole words in any case, numbers exactly, word* as a prefix; ValueError for other uses of *."""
    return [positional.pattern_of(t) for t in positional.terms_of(query)] if query.strip() else []


def matches_all(text: Column, patterns: list[str]) -> Column:
    out = F.lit(bool(patterns))
    for p in patterns:
        out = out & text.rlike(p)
    return out


def hits(docs: DataFrame, query: str) -> DataFrame:
    """(id, line_no, rank) of every line that a query hits: rank 0 the phrase on a line, 1 all terms on it, 2 all in three lines, however long they are.

    Documents without all terms are left out before any line is cut.
    """
    return positional.matching(positional.lines(_holding(docs, query)), query).select("id", "line_no", "rank")


def find(docs: DataFrame, query: str) -> DataFrame:
    """(id, line_no, rank, start, end, start_line, last_line, excerpt): those of `hits` whose excerpt holds all terms, which one of long lines may not.

    Hits meet their lines, never whole texts.  For many queries over the same documents see `positional.search`.
    """
    cut = stored(positional.lines(_holding(docs, query)), "lines")
    asked = docs.sparkSession.createDataFrame([(0, query.strip().lower(), query_patterns(query))], "query_id int, phrase string, patterns array<string>")
    return positional.excerpts(positional.matching(cut, query), cut, asked).drop("query_id")


def _holding(docs: DataFrame, query: str) -> DataFrame:
    return docs.filter(matches_all(F.col("text"), query_patterns(query)))


def best_hits(found: DataFrame, hits: int = HITS, budget: int = BUDGET) -> DataFrame:
    """The first hits by rank, id, line that do not overlap an earlier one and fit a budget of JSON characters together.

    Each is the least of all that still may follow, so no candidate is cut off; the driver sees the chosen ones only.
    """
    left = stored(found.withColumn("cost", F.char_length(F.to_json(F.struct("id", "line_no", "excerpt")))), "hits")
    names, spent, chosen = ["rank", "id", "line_no", "start", "end", "start_line", "last_line", "excerpt", "cost"], 0, []
    while len(chosen) < hits:
        fits = left.filter(F.col("cost") <= budget - spent)
        for c in chosen:
            before = F.struct(*(F.lit(c[n]).cast(left.schema[n].dataType).alias(n) for n in ("rank", "id", "line_no")))
            fits = fits.filter(F.struct("rank", "id", "line_no") > before)
            fits = fits.filter((F.col("id") != F.lit(c["id"])) | (F.col("start") >= c["end"]) | (F.col("end") <= c["start"]))
        best = fits.agg(F.min(F.struct(*names)).alias("x")).head()["x"]
        if best is None:
            break
        chosen.append(best)
        spent += best["cost"]
    return found.sparkSession.createDataFrame([tuple(c[n] for n in names) for c in chosen], left.select(*names).schema).drop("cost")


def read_lines(docs: DataFrame, spans: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(span_id, id, text, issue) for spans (span_id, id, start_line, end_line), inclusive and from 1.

    With gaps (id, gaps: array<struct<label, reason, start, end>>) also a column gaps: those that meet the lines that were read.
    """
    valid = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") - F.col("start_line") < MOST_LINES)
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    rows = lines(docs).withColumnRenamed("id", "line_id")
    each = spans.join(rows, (F.col("id") == F.col("line_id")) & inside & valid, "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside & valid, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    ends = F.min("start").alias("from"), F.max(F.col("start") + F.char_length("line")).alias("upto")
    out = each.groupBy("span_id", "id").agg(text.alias("text"), F.bool_and(valid).alias("valid"), F.max(F.when(inside, F.col("line_no"))).alias("last"), *ends)
    issue = F.when(~F.col("valid"), "bad span").when(F.col("last").isNull(), "no such lines").when(F.char_length("text") > MOST_CHARS, "too long")
    read = F.when(issue.isNull(), F.col("text")).alias("text")
    if gaps is None:
        return out.select("span_id", "id", read, issue.alias("issue"))
    met = F.when(issue.isNull(), relevant_gaps(F.col("gaps"), F.col("from"), F.col("upto")))
    return out.join(gaps.select("id", "gaps"), "id", "left").select("span_id", "id", read, issue.alias("issue"), met.alias("gaps"))


def list_sections(docs: DataFrame, query: str = "", most: int = SECTIONS, budget: int = BUDGET) -> DataFrame:
    """(id, section, label, first_line, total, truncated): the first sections whose label has all terms, within a budget.

    first_line is the last line that begins at or before the section (an as-of match of offsets).
    """
    spans = section_spans(docs)
    if query.strip():
        spans = spans.filter(matches_all(F.col("label"), query_patterns(query)))
    order = Window.partitionBy("id").orderBy("section")
    rows = spans.withColumns({
        "n": F.row_number().over(order), "total": F.count(F.lit(1)).over(Window.partitionBy("id")),
        "spent": F.sum(F.char_length(F.to_json(F.struct("section", "label")))).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.filter((F.col("n") <= most) & (F.col("spent") <= budget)).withColumn("truncated", F.max("n").over(Window.partitionBy("id")) < F.col("total"))
    at = lines(docs).select("id", "line_no", F.col("start").alias("offset"))
    asof = F.max(F.when(F.col("offset") <= F.col("start"), F.col("line_no")))
    return rows.join(at, "id").groupBy("id", "section", "label", "total", "truncated").agg(asof.alias("first_line"))


def read_sections(docs: DataFrame, wanted: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(id, label, text, issue) for wanted (id, label): issues none, ambiguous, unavailable, overlaps gap, too large.

    gaps (id, label, start, end): a section of a gap's own label is unavailable, one that meets another gap overlaps it.
    """
    spans = section_spans(docs)
    found = wanted.join(spans, ["id", "label"], "left").groupBy("id", "label").agg(F.count("section").alias("n"), F.min("start").alias("start"), F.min("end").alias("end"))
    if gaps is None:
        found = found.withColumns({"closed": F.lit(False), "met": F.lit(False)})
    else:
        g = gaps.select(F.col("id").alias("g_id"), F.col("label").alias("g_label"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
        same = F.coalesce(F.col("g_label") == F.col("label"), F.lit(False))
        meets = F.coalesce((F.col("g_start") < F.col("end")) & (F.col("g_end") > F.col("start")), F.lit(False))
        found = found.join(g, F.col("id") == F.col("g_id"), "left").groupBy("id", "label", "n", "start", "end").agg(F.bool_or(same).alias("closed"), F.bool_or(meets).alias("met"))
    issue = (
        F.when(F.col("closed"), "unavailable").when(F.col("n") == 0, "none").when(F.col("n") > 1, "ambiguous").when(F.col("met"), "overlaps gap").when(F.col("end") - F.col("start") > MOST_CHARS, "too large")
    )
    out = found.join(docs.select("id", F.col("text").alias("body")), "id", "left").withColumn("issue", issue)
    return out.select("id", "label", F.when(F.col("issue").isNull(), F.substring("body", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))).alias("text"), "issue")


def smallest_section(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, id, label): the shortest section that holds a quote's interval (quote_id, id, q_start, q_end)."""
    held = (F.col("start") <= F.col("q_start")) & (F.col("end") >= F.col("q_end"))
    return quotes.join(section_spans(docs), "id").filter(held).groupBy("quote_id", "id").agg(F.min_by("label", F.col("end") - F.col("start")).alias("label"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(id, start, end): overlapping or touching spans of an id put together."""
    order = Window.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(order)
    return spans.withColumn("island", island).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def relevant_gaps(gaps: Column, start: Column, end: Column) -> Column:
    """Of array<struct<label, reason, start, end>> those that meet a half-open interval, labels and reasons cut."""
    met = F.filter(gaps, lambda g: (g["start"] < end) & (g["end"] > start))
    return F.transform(met, lambda g: F.struct(F.substring(g["label"], 1, 240).alias("label"), F.substring(g["reason"], 1, 180).alias("reason")))


__all__ = ["best_hits", "find", "hits", "list_sections", "matches_all", "merged_spans", "query_patterns", "quoted", "read_lines", "read_sections", "relevant_gaps", "smallest_section"]
