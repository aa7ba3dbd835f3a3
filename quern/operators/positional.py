"""A positional index of documents' lines, and search of many queries at once through it.

The index has a row for each run of letters, digits and underscores in a document: its lower-case term and the lines that have it.  Of a run of
the digits 0 to 9, which may be a part of a number, it also has each place in its line and the sign before.  Rows lie in folders by a hash of the
term; each task writes its own file of a folder, so that a frequent term is not one task's and nothing is shuffled.  A search reads only the
folders of its terms.  A term of a query is one run, the beginning of one (word*), or several that
follow each other at the right distance (1,000.50), which is a join of places.  The lines of each term, then each query, are put together by document;
hits meet the lines of their document, each of which is shuffled once whatever the number of queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.chunks import LINE_END
from quern.tables import few, spread, stored

EXCERPT = 1200
FOLDERS = 64
CODEC = "zstd"  # these tables are as large as the documents
_RUN = re.compile(r"\w+")
_DIGIT, _DIGITS, _JOINTS = re.compile("[0-9]").search, re.compile("[0-9]+").fullmatch, (".", ",")
_TERM = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+\*?")
_END = re.compile(LINE_END.replace(r"\x{85}", "\x85").replace(r"\x{2028}", "\u2028").replace(r"\x{2029}", "\u2029"))


def terms_of(query: str) -> list[str]:
    """A query's terms: words, numbers, word* for a prefix; ValueError for other uses of *."""
    found = _TERM.findall(query)
    if sum(t.endswith("*") for t in found) != query.count("*") or re.search(r"\*\w", query):
        raise ValueError("* may only end a word of letters")
    return found


def pattern_of(term: str) -> str:
    """A term as a pattern: whole words in any case, numbers exactly, word* as a prefix."""
    word = r"\p{L}\p{N}_"
    return rf"(?iu)(?<![{word}]){re.escape(term.rstrip('*'))}{r'\p{L}*' if term.endswith('*') else ''}(?![{word}])"


def lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, start, full): lines from 1 with their line ends and offsets in characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                place, number, start, full = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    begin, n = 0, 0
                    for end in [*(m.end() for m in _END.finditer(text or "")), len(text or "")]:
                        if end > begin:
                            n += 1
                            place.append(i)
                            number.append(n)
                            start.append(begin)
                            full.append(text[begin:end])
                        begin = end
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(place, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(full, pa.string())], ["id", "line_no", "start", "full"])

    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs.select("id", "text")).mapInArrow(cut, f"id {kind}, line_no int, start int, full string")


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables of runs (folder, term, id, line_no, place, gap) and of lines (id, line_no, start, full), from columns id, text.

    line_no and place are arrays, gap is a string: of a run of digits they have an entry each time, of others line_no has each line once.
    """
    cut = stored(lines(docs), "lines", codec=CODEC)
    kind = docs.schema["id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("id").to_pylist()
                found: dict[tuple, tuple[list, list, list]] = {}
                row = 0  # the first of its document here
                for i, (number, line) in enumerate(zip(part.column("line_no").to_pylist(), part.column("full").to_pylist())):
                    row = row if ids[i] == ids[row] else i
                    for term in {x.lower() for x in set(_RUN.findall(line))}:
                        if not _DIGITS(term):
                            found.setdefault((row, term), ([], [], []))[0].append(number)
                    if _DIGIT(line):
                        last = 0
                        for n, m in enumerate(_RUN.finditer(line)):
                            if _DIGITS(m[0]):
                                numbers, places, gaps = found.setdefault((row, m[0]), ([], [], []))
                                numbers.append(number)
                                places.append(n)
                                before = line[last : m.start()]
                                gaps.append(before if before in _JOINTS else " ")  # only such join the parts of a number
                            last = m.end()
                yield pa.RecordBatch.from_arrays([
                    pa.array([t for _, t in found], pa.string()), part.column("id").take(pa.array([i for i, _ in found], pa.int64())),
                    pa.array([x[0] for x in found.values()], pa.list_(pa.int32())), pa.array([x[1] for x in found.values()], pa.list_(pa.int32())),
                    pa.array(["".join(x[2]) for x in found.values()], pa.string()),
                ], ["term", "id", "line_no", "place", "gap"])

    found = cut.select("id", "line_no", "full").mapInArrow(runs, f"term string, id {kind}, line_no array<int>, place array<int>, gap string")
    found = found.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    return stored(found.sortWithinPartitions("folder", "term"), "runs", by=["folder"], codec=CODEC), cut


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, patterns, term, n_terms, parts, part, run, gap, prefix) of queries (query_id, query); wrong ones have no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for query_id, query in zip(rows["query_id"], rows["query"]):
                try:
                    terms = terms_of(query or "")
                except ValueError:
                    continue
                patterns = [pattern_of(t) for t in terms]
                for term in terms:
                    pieces = re.split("([.,])", term.rstrip("*")) if term[0].isdigit() else [term.rstrip("*")]
                    for j, run in enumerate(pieces[::2]):
                        out.append((query_id, query.strip().lower(), patterns, term.lower(), len({t.lower() for t in terms}), len(pieces) // 2 + 1, j, run.lower(), pieces[2 * j - 1] if j else None, term.endswith("*")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.split(", ")])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(parse, f"query_id {kind}, " + _PARSED.split(", ", 1)[1])


_PARSED = "query_id, phrase string, patterns array<string>, term string, n_terms int, parts int, part int, run string, gap string, prefix boolean"


def search(runs: DataFrame, cut: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, line_no, rank, start, end, start_line, last_line, excerpt) of queries (query_id, query) in an index.

    rank 0: the phrase is on the line, 1: all terms are, 2: all are in it and the two lines after it.  A query without terms has no hits.
    """
    terms = stored(parsed(queries).withColumn("folder", F.pmod(F.xxhash64("run"), F.lit(FOLDERS)).cast("int")), "query-terms")
    # queries share their terms
    needles = terms.select(F.col("term").alias("key"), "parts", "part", "run", F.col("gap").alias("wanted"), "prefix", "folder").distinct()
    whole, chain = needles.filter("parts = 1 and not prefix"), needles.filter("parts > 1")
    met = _read(runs, whole).join(few(whole.select("key", "run")), F.col("term") == F.col("run")).select("id", "key", "line_no")
    first = lambda c: F.substring(c, 1, 1)
    starts = few(needles.filter("prefix").select("key", "run", first("run").alias("initial")))
    rest = F.col("term").startswith(F.col("run")) & F.expr("substring(term, length(run) + 1)").rlike(r"^\p{L}*$")
    begun = runs.join(starts, first("term") == F.col("initial")).filter(rest).select("id", "key", "line_no")
    # parts of one number follow each other
    each = _read(runs, chain).join(few(chain.drop("folder", "prefix")), F.col("term") == F.col("run"))
    each = each.select("id", "key", "parts", "part", "wanted", "gap", "line_no", F.posexplode("place").alias("n", "at"))
    each = each.filter(F.col("wanted").isNull() | (F.col("wanted") == F.expr("substring(gap, n + 1, 1)")))
    each = each.groupBy("id", "key", "parts", F.expr("line_no[n]").alias("line"), (F.col("at") - F.col("part")).alias("at")).agg(F.count_distinct("part").alias("n"))
    chained = each.filter("n = parts").select("id", "key", F.array("line").alias("line_no"))
    # from here on a document is one task's
    own = met.unionByName(begun).unionByName(chained).repartition("id").groupBy("id", "key").agg(F.flatten(F.collect_list("line_no")).alias("lines"))
    wanting = few(terms.select("query_id", F.col("term").alias("key"), "n_terms").distinct())
    held = own.join(wanting, "key").groupBy("id", "query_id", "n_terms").agg(F.collect_list("lines").alias("l")).filter(F.size("l") == F.col("n_terms"))
    common = lambda lists: F.aggregate(lists, lists[0], F.array_intersect)
    near = F.transform("l", lambda x: F.flatten(F.transform(x, lambda n: F.sequence(F.greatest(F.lit(1), n - 2), n))))
    held = held.select("id", "query_id", common(F.col("l")).alias("here"), common(near).alias("near"))
    ranked = lambda lists, rank: F.transform(lists, lambda n: F.struct(n.alias("line_no"), F.lit(rank).alias("rank")))
    hits = held.select("id", "query_id", F.explode(F.concat(ranked(F.col("here"), 1), ranked(F.array_except("near", "here"), 2))).alias("x"))
    asked = terms.groupBy("query_id").agg(F.first("phrase").alias("phrase"), F.first("patterns").alias("patterns"))
    return excerpts(hits.select("query_id", "id", "x.line_no", "x.rank"), cut, asked)


def _read(runs: DataFrame, needles: DataFrame) -> DataFrame:
    return runs.filter(F.col("folder").isin([r["folder"] for r in needles.select("folder").distinct().collect()]))  # FOLDERS at most


def excerpts(hits: DataFrame, cut: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits (query_id, id, line_no, rank) with their excerpts from lines (id, line_no, start, full), of queries (query_id, phrase, patterns).

    Of those of rank 1 the phrase is looked for.  An excerpt is the line or lines with the neighbours on each side that fit whole in EXCERPT
    characters; of longer ones EXCERPT characters from shortly before the match.  One that lacks a term then is no hit.  Hits and lines meet by
    document; a line goes to its neighbours there, and only then to each of its hits.
    """
    line = cut.select("id", "line_no", F.struct("start", "full").alias("line"), F.lit(None).cast(hits.select(F.struct("query_id", "rank").alias("x")).schema["x"].dataType).alias("hit"))
    hit = hits.select("id", "line_no", F.lit(None).cast(line.schema["line"].dataType).alias("line"), F.struct("query_id", "rank").alias("hit"))
    rows = line.unionByName(hit).repartition("id").groupBy("id", "line_no").agg(F.first("line", True).alias("line"), F.collect_list("hit").alias("hits"))
    order = Window.partitionBy("id").orderBy("line_no")
    rows = rows.withColumns({"l0": F.lag("line").over(order)} | {f"l{i + 1}": F.lead("line", i).over(order) for i in (1, 2, 3)})
    rows = rows.filter(F.size("hits") > 0).withColumn("hit", F.explode("hits")).select("id", "line_no", "hit.*", "line", "l0", "l2", "l3", "l4")
    rows = rows.join(few(stored(asked, "queries")), "query_id")
    full = lambda c: F.coalesce(F.col(c)["full"], F.lit(""))
    three = F.col("rank") == 2
    rows = rows.withColumn("core", F.when(three, F.concat(full("line"), full("l2"), full("l3"))).otherwise(full("line")))
    rows = rows.withColumns({"low": F.lower("core"), "size": F.char_length("core"), "after": F.when(three, full("l4")).otherwise(full("l2"))})
    rows = rows.withColumn("rank", F.when((F.col("rank") == 1) & F.col("low").contains(F.col("phrase")), 0).otherwise(F.col("rank")))
    long_ = F.col("size") > EXCERPT
    # only long lines are cut, so that only they are searched again
    offset = lambda p: F.char_length(F.split("low", p, 2)[0])
    match = F.when(long_ & (F.col("rank") == 0), F.instr("low", F.col("phrase")) - 1).when(long_, F.array_min(F.transform("patterns", offset)))
    rows = rows.withColumn("from", F.greatest(F.lit(0), match - 100).cast("int"))
    before = F.when(F.char_length(full("l0")) + F.col("size") <= EXCERPT, full("l0")).otherwise("")
    rows = rows.withColumn("before", before)
    fits = F.char_length("before") + F.col("size") + F.char_length("after") <= EXCERPT
    excerpt = F.when(long_, F.substring("core", F.col("from") + 1, F.lit(EXCERPT))).otherwise(F.concat("before", "core", F.when(fits, F.col("after")).otherwise("")))
    start = F.col("line")["start"] + F.when(long_, F.col("from")).otherwise(-F.char_length("before"))
    rows = rows.withColumns({"excerpt": excerpt, "start": start})
    rows = rows.filter(F.when(long_, F.forall("patterns", lambda p: F.regexp_like(F.col("excerpt"), p))).otherwise(F.lit(True)))
    rows = rows.withColumn("end", F.col("start") + F.char_length("excerpt"))
    begins = lambda c, at: F.coalesce((F.col(c)["start"] <= at).cast("int"), F.lit(0))
    of = lambda at: F.col("line_no") - 1 + begins("line", at) + begins("l2", at) + begins("l3", at) + begins("l4", at)
    return rows.select("query_id", "id", "line_no", "rank", "start", "end", of(F.col("start")).alias("start_line"), of(F.col("end") - 1).alias("last_line"), "excerpt")


def matching(cut: DataFrame, query: str) -> DataFrame:
    """Every hit of one query as `excerpts` takes them, by a scan of lines: for documents that are searched only once."""
    patterns = [pattern_of(t) for t in terms_of(query)] if query.strip() else []
    order = Window.partitionBy("id").orderBy("line_no")
    all_of = lambda c: _all(c, patterns)
    three = F.concat("full", F.coalesce(F.lead("full", 1).over(order), F.lit("")), F.coalesce(F.lead("full", 2).over(order), F.lit("")))
    rank = F.when(all_of(F.col("full")), F.when(F.lower("full").contains(query.strip().lower()), 0).otherwise(1)).when(all_of(F.col("three")), 2)
    return cut.withColumn("three", three).withColumn("rank", rank).filter("rank is not null").select(F.lit(0).alias("query_id"), "id", "line_no", "rank")


def _all(text: Column, patterns: list[str]) -> Column:
    out = F.lit(bool(patterns))
    for p in patterns:
        out = out & text.rlike(p)
    return out
