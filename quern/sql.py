"""Search and reading of documents from SQL: table functions over a table of documents (id, text).

    register(spark)
    spark.sql("SELECT * FROM find_in(TABLE(laws), 'land tax')")
    spark.sql("SELECT * FROM read_lines_of(TABLE(laws), 1, 40)")
    spark.sql("SELECT * FROM sections_of(TABLE(laws), '')")
    spark.sql("SELECT * FROM best_hits_of(TABLE(hits), 6, 10000)")

Their rows are those of `search.find`, `read_lines`, `list_sections` and, for each query, `best_hits`.  The first three see a document at a time, so
they need no shuffle: texts stay where they were read.  best_hits_of is partitioned by query and ordered by rank, id and line: one pass
that ends a query's input once it has its hits, and holds no others.  Null texts are empty; other columns of a table are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quern.operators.chunks import HEADING, LINE_END
from quern.operators.positional import EXCERPT, terms_of
from quern.operators.search import BUDGET, MOST_CHARS, MOST_LINES, SECTIONS

HIT = "line_no int, rank int, start int, end int, start_line int, last_line int, excerpt string"


def _java(pattern: str) -> str:
    """A pattern of the column functions in Python's spelling."""
    starts = pattern.replace("(?m)^", r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))")
    return re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), starts)


def _analyzed(table: AnalyzeArgument, out: str, *values: tuple[AnalyzeArgument, type]) -> AnalyzeResult:
    """The schema of a function of documents: their id's type and the columns of out; wrong arguments are errors of the query."""
    names = table.dataType.fieldNames() if table.isTable else []
    if not {"id", "text"} <= set(names):
        raise ValueError("the first argument is TABLE(documents), with columns id and text")
    for value, kind in values:
        if not value.isConstantExpression or type(value.value) is not kind:
            raise ValueError(f"a constant of type {kind.__name__} is needed")
    schema = StructType([table.dataType["id"], *_schema(out)])
    return AnalyzeResult(schema=schema)


def _schema(columns: str) -> StructType:
    kinds = {"int": IntegerType(), "long": LongType(), "string": StringType(), "boolean": BooleanType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _patterns(query: str) -> list[re.Pattern]:
    terms = terms_of(query) if query.strip() else []
    return [re.compile(rf"(?<!\w){re.escape(t.rstrip('*'))}{'[^\\W\\d_]*' if t.endswith('*') else ''}(?!\w)", re.I) for t in terms]


def _bounds(text: str) -> list[int]:
    """Where lines begin, and the end of the text; a final line end opens no further line."""
    out = [0, *(m.end() for m in re.finditer(_java(LINE_END), text))]
    return out if out[-1] == len(text) and text else [*out, len(text)] if text else [0]


class Find:
    """Hits of a query in each document."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        out = _analyzed(docs, HIT, (query, str))
        terms_of(query.value)  # a wrong query is an error before any document is read
        return out

    def eval(self, row: Row, query: str) -> Iterator[tuple]:
        text, patterns, phrase = row["text"] or "", _patterns(query), query.strip().lower()
        if not patterns or not all(p.search(text) for p in patterns):
            return
        at = _bounds(text)
        n = len(at) - 1
        for i in range(n):
            rank, last = 1, i + 1
            if not all(p.search(text[at[i] : at[i + 1]]) for p in patterns):
                rank, last = 2, min(i + 3, n)
                if not all(p.search(text[at[i] : at[last]]) for p in patterns):
                    continue
            start, stop = at[i], at[last]
            core = text[start:stop].lower()
            rank = 0 if rank == 1 and phrase in core else rank
            if stop - start > EXCERPT:
                first = core.index(phrase) if rank == 0 else min(p.search(core).start() for p in patterns)
                start = max(start, start + first - 100)
                stop = min(stop, start + EXCERPT)
                if not all(p.search(text[start:stop]) for p in patterns):
                    continue
            else:
                if i and stop - at[i - 1] <= EXCERPT:
                    start = at[i - 1]
                if last < n and at[last + 1] - start <= EXCERPT:
                    stop = at[last + 1]
            yield row["id"], i + 1, rank, start, stop, bisect_right(at, start), bisect_right(at, stop - 1), text[start:stop]


class ReadLines:
    """Lines of each document, from 1 and inclusive, or why they are not read."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, start_line: AnalyzeArgument, end_line: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(docs, "text string, issue string", (start_line, int), (end_line, int))

    def eval(self, row: Row, start_line: int, end_line: int) -> Iterator[tuple]:
        if start_line < 1 or end_line < start_line or end_line - start_line >= MOST_LINES:
            yield row["id"], None, "bad span"
            return
        text = row["text"] or ""
        at = _bounds(text)
        lines = [re.sub(rf"(?:{_java(LINE_END)})\Z", "", text[a:b]) for a, b in zip(at[start_line - 1 : end_line], at[start_line : end_line + 1])]
        read = "\n".join(lines)
        issue = "no such lines" if not lines else "too long" if len(read) > MOST_CHARS else None
        yield row["id"], None if issue else read, issue


class Sections:
    """The first sections of each document whose label has all terms, within a budget."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        out = _analyzed(docs, "section int, label string, first_line int, total long, truncated boolean", (query, str))
        terms_of(query.value)
        return out

    def eval(self, row: Row, query: str) -> Iterator[tuple]:
        text, patterns, at, found = row["text"] or "", _patterns(query), _bounds(row["text"] or ""), []
        starts = [m.start() for m in re.finditer(_java(HEADING), text)]
        before = 0 if starts[:1] == [0] else 1
        for k, start in enumerate(starts):
            label = re.split(_java(LINE_END), text[start : (starts + [len(text)])[k + 1]], maxsplit=1)[0].strip()[:240]
            if all(p.search(label) for p in patterns):
                found.append((k + before, label, bisect_right(at, start)))
        kept, spent = [], 0
        for section, label, line in found[:SECTIONS]:
            spent += len(json.dumps({"section": section, "label": label}, ensure_ascii=False, separators=(",", ":")))
            if spent > BUDGET:
                break
            kept.append((section, label, line))
        for section, label, line in kept:
            yield row["id"], section, label, line, len(found), len(kept) < len(found)


class BestHits:
    """For each query the first hits by rank, id and line that overlap none before and fit a budget together."""

    @staticmethod
    def analyze(hits: AnalyzeArgument, most: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        need = ["query_id", "id", "line_no", "rank", "start", "end", "excerpt", "cost"]
        if not hits.isTable or not set(need) <= set(hits.dataType.fieldNames()):
            raise ValueError(f"the first argument is TABLE(hits), with columns {', '.join(need)}")
        schema = StructType([f for f in hits.dataType if f.name != "cost"])
        order = [OrderingColumn("rank"), OrderingColumn("id"), OrderingColumn("line_no")]
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=order)

    def __init__(self):
        self.chosen, self.spent = [], 0

    def eval(self, row: Row, most: int, budget: int) -> Iterator[tuple]:
        if len(self.chosen) == most:
            raise SkipRestOfInputTableException("the query has its hits")
        apart = all(row["id"] != i or row["start"] >= b or row["end"] <= a for i, a, b in self.chosen)
        if apart and self.spent + row["cost"] <= budget:
            self.chosen.append((row["id"], row["start"], row["end"]))
            self.spent += row["cost"]
            yield tuple(v for c, v in row.asDict().items() if c != "cost")


FUNCTIONS = {"find_in": Find, "read_lines_of": ReadLines, "sections_of": Sections, "best_hits_of": BestHits}


def register(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql under the names of FUNCTIONS."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
