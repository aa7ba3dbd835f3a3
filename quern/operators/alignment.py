"""Where quotes stand in documents: a ladder of ever weaker rules, each of which sees only what the rules before left.

A quote begins and ends with whole words (runs of letters, digits and underscores).  Its first words are joined to the documents' windows of
as many words, then the document's word at its end is looked up by number: joins of places; of texts only the blocks that hits meet are joined.  Rungs:

1. exact: the quote stands in the document as it is; its first place.
2. spaces: but for white space, at one place only.
3. prefix: its first four words stand at one place only; from there the quote's length and 80 characters more, to the last whole word.
4. article: of the article that the citation names, the first line of over 35 characters that is no heading and stands once in the document.

What has no rung stays without a passage: no rule takes any line that happens to fit.

Rungs 1 to 3 can also be told character by character (whole=False): quotes then begin and end anywhere, also inside words or outside of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import squeeze, strip
from quern.operators import chunks, offsets, substrings
from quern.tables import BROADCAST_ROWS, few, spread, stored

ANCHOR, MORE, LINE, CONTEXT, LEAST = 4, 80, 35, 12_000, 50
BLOCK = 1 << 12
_RUN = re.compile(r"\w+")
_NUMBER = r"[0-9]+(?:-[0-9]+)?"
#: How articles begin: also a number before its word.
ARTICLES = chunks.HEADING + r"|(?m)^(?=[ \t]*[0-9]+(?:-[0-9]+)?-бап)"


def _words(docs: DataFrame, columns: str, emit: Callable[[list[re.Match]], list[list]]) -> DataFrame:
    """(id, columns) of each text's runs of word characters, as emit gives them: a list for each column."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time, so that a batch of long ones stays small
                out = emit(list(_RUN.finditer(batch.column("text")[i].as_py() or "")))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([i] * len(out[0]), pa.int64())), *map(pa.array, out, types)], ["id", *names])

    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs.select("id", "text")).mapInArrow(cut, f"id {kind}, {columns}")


def _windows(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, no, start, head): the windows of runs in documents that are among heads (head); those of one run to ANCHOR.

    Up to BROADCAST_ROWS heads go to the tasks, which then give no other windows; more of them are joined by a shuffle.
    """
    known = [tuple(r["head"]) for r in heads.limit(BROADCAST_ROWS + 1).collect()]
    every = len(known) > BROADCAST_ROWS
    lengths = range(1, ANCHOR + 1) if every else sorted({len(h) for h in known})
    wanted = docs.sparkSession.sparkContext.broadcast({} if every else by_first(known))

    def emit(found: list[re.Match]) -> list[list]:
        words, chosen = [m[0] for m in found], wanted.value
        out: list[list] = [[], [], []]
        for j, first in enumerate(words):
            own = None if every else chosen.get(first)
            if every or own:
                for k in lengths:
                    head = tuple(words[j : j + k])
                    if len(head) == k and (every or head in own):
                        out[0].append(j)
                        out[1].append(found[j].start())
                        out[2].append(head)
        return out

    return _words(docs, "no int, start int, head array<string>", emit)


def by_first(heads: list[tuple[str, ...]]) -> dict[str, set[tuple[str, ...]]]:
    out: dict[str, set[tuple[str, ...]]] = {}
    for head in heads:
        out.setdefault(head[0], set()).add(head)
    return out


def _quotes(citations: DataFrame) -> DataFrame:
    """(citation_id, wanted, quote, words, lead, tail, prefix): a quote's runs and what stands before and after them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q in batch.column("quote").to_pylist():
                found = list(_RUN.finditer(q or ""))
                out.append(([m[0] for m in found], found[0].start(), len(q) - found[-1].end(), q[: found[min(ANCHOR, len(found)) - 1].end()]) if found else ([], 0, 0, ""))
            columns = [batch.column(c) for c in ("citation_id", "id", "quote")]
            kinds = pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()
            yield pa.RecordBatch.from_arrays(columns + [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["citation_id", "wanted", "quote", "words", "lead", "tail", "prefix"])

    a, b = (citations.schema[c].dataType.simpleString() for c in ("citation_id", "id"))
    rows = citations.select("citation_id", "id", strip(F.col("quote")).alias("quote"))
    return rows.mapInArrow(cut, f"citation_id {a}, wanted {b}, quote string, words array<string>, lead int, tail int, prefix string").filter("size(words) > 0")


def blocks(docs: DataFrame) -> DataFrame:
    """(id, block, full): texts in blocks of BLOCK characters."""
    n = F.greatest(F.lit(0), F.floor((F.char_length("text") - 1) / BLOCK)).cast("int")
    each = docs.filter("text != ''").select("id", F.explode(F.sequence(F.lit(0), n)).alias("block"), "text")
    return each.select("id", "block", F.substring("text", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("full"))


def slices(cut: DataFrame, places: DataFrame) -> DataFrame:
    """places (key, id, a, b) with slice: the characters from a to b, put together from the blocks they meet."""
    last = F.floor((F.greatest(F.col("a"), F.col("b") - 1)) / BLOCK)
    met = places.select("key", "id", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / BLOCK).cast("int"), last.cast("int"))).alias("block")).join(cut, ["id", "block"])
    part = F.struct("block", F.substring("full", F.greatest(F.lit(0), F.col("a") - F.col("block") * BLOCK).cast("int") + 1, (F.least(F.lit(BLOCK), F.col("b") - F.col("block") * BLOCK) - F.greatest(F.lit(0), F.col("a") - F.col("block") * BLOCK)).cast("int")).alias("s"))
    return met.groupBy("key", "id", "a", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]), "").alias("slice"))


def aligned(citations: DataFrame, docs: DataFrame, whole: bool = True) -> DataFrame:
    """(citation_id, id, rung, start, passage) of citations (citation_id, id, article, quote) in documents (id, text).

    A citation with a null id is looked for in all documents and has a row for each that has it by rungs 1 to 3; one with an id has one row, with
    a null rung where nothing was found.  Ids of citations and of documents are unique; null texts and quotes are empty.  A passage that
    many documents have gives as many rows: they are the result.

    whole: quotes and their first words begin and end with whole words of the document, and white space at a quote's ends is left out; else
    each character of a quote counts, and places that hold the quote once are counted without overlaps.
    """
    key = ["citation_id", "id"]
    found = _by_words(citations, docs) if whole else substrings.occurrences(citations, docs, MORE)
    asked = citations.filter("id is not null").select(*key, "article")
    found = found.unionByName(stored(_by_article(asked.join(found, key, "left_anti"), docs), "article-lines"))
    none = asked.select(*key).join(found, key, "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


def _by_words(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Rungs 1 to 3 by whole words."""
    quotes = stored(_quotes(citations), "quotes")
    hits = stored(_places(quotes, docs), "places")
    cut = stored(blocks(docs.join(hits.select("id").distinct(), "id", "left_semi")), "blocks")
    found = stored(_verified(hits, quotes, docs, cut), "whole")
    return found.unionByName(stored(_prefixed(hits.join(found, ["citation_id", "id"], "left_anti"), quotes, cut), "prefixes"))


def _places(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(citation_id, id, no, start): where a quote's first words, ANCHOR at most, stand in documents."""
    asked = quotes.select("citation_id", "wanted", "lead", F.slice("words", F.lit(1), F.lit(ANCHOR)).alias("head"))
    met = _windows(docs, asked.select("head").distinct()).join(few(asked), "head").filter("wanted is null or wanted = id")
    return met.select("citation_id", "id", "no", F.greatest(F.lit(0), F.col("start") - F.col("lead")).alias("start"))


def _verified(hits: DataFrame, quotes: DataFrame, docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Rungs 1 and 2 of hits: the text up to the word at the quote's end is the quote's."""
    # not broadcast by their number: quotes may be long; what is small is broadcast by its size as it runs
    own = hits.join(quotes.select("citation_id", "tail", F.size("words").alias("n"), "quote"), "citation_id")
    own_docs = docs.join(hits.select("id").distinct(), "id", "left_semi")
    ends = _words(own_docs, "last int, stop int", lambda found: [list(range(len(found))), [m.end() for m in found]])
    rows = own.withColumn("last", F.col("no") + F.col("n") - 1).join(ends, ["id", "last"])
    rows = rows.select("id", F.struct("citation_id", "quote").alias("key"), F.col("start").alias("a"), (F.col("stop") + F.col("tail")).alias("b"))
    read = slices(cut, rows).select("key.*", "id", "a", "slice")
    exact, same = F.col("slice") == F.col("quote"), squeeze(F.col("slice")) == squeeze(F.col("quote"))
    best = lambda c: F.min(F.when(c, F.struct("a", "slice")))
    each = read.groupBy("citation_id", "id").agg(best(exact).alias("exact"), best(same).alias("same"), F.count_if(same).alias("n"))
    x = F.coalesce("exact", F.when(F.col("n") == 1, F.col("same")))
    rung = F.when(F.col("exact").isNotNull(), "exact").otherwise("spaces")
    return each.filter(x.isNotNull()).select("citation_id", "id", rung.alias("rung"), x["a"].alias("start"), x["slice"].alias("passage"))


def _prefixed(hits: DataFrame, quotes: DataFrame, cut: DataFrame) -> DataFrame:
    """Rung 3 of hits: quotes of ANCHOR words at least whose first ones stand at one place of the document."""
    long_ = quotes.filter(F.size("words") >= ANCHOR).select("citation_id", "prefix", (F.char_length("quote") + MORE).alias("size"))
    rows = hits.join(long_, "citation_id").select("id", F.struct("citation_id", "prefix", "size").alias("key"), F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    read = slices(cut, rows).select("key.*", "id", "a", "slice").filter(F.col("slice").startswith(F.col("prefix")))
    one = read.groupBy("citation_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("start"), F.first("slice").alias("slice"), F.first("size").alias("size")).filter("n = 1")
    whole = F.when(F.char_length("slice") == F.col("size"), F.regexp_replace("slice", r"\s+\S*\z", "")).otherwise(F.col("slice"))
    return one.select("citation_id", "id", F.lit("prefix").alias("rung"), "start", strip(whole).alias("passage"))


def sections(docs: DataFrame) -> DataFrame:
    """(id, piece, start, end, number): what stands before the first article and each article, with the number of its heading."""
    parts = docs.filter("text is not null").select("id", F.posexplode(F.split("text", ARTICLES)).alias("piece", "body"))
    n = F.char_length("body").cast("long")
    end = F.sum(n).over(Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    first = F.regexp_extract("body", chunks.FIRST_LINE, 0)
    number = F.when(F.col("body").rlike(ARTICLES.replace("(?m)^", r"\A")), F.regexp_extract(first, _NUMBER, 0))
    return parts.select("id", "piece", (end - n).alias("start"), end.alias("end"), F.nullif(number, F.lit("")).alias("number"))


def contexts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(citation_id, id, number, found, piece, start, end) of asked (citation_id, id, article): the article of a document that a citation names.

    Its numbers are tried from the last: the first article of LEAST characters with that number (found: heading), else the part of the
    document in which the number is first mentioned as an article (mention: an as-of match to the nearest heading before it).
    """
    numbers = F.regexp_extract_all("article", F.lit(_NUMBER), F.lit(0))
    each = asked.filter("article is not null").select("citation_id", "id", F.posexplode(F.when(F.size(numbers) > 0, numbers).otherwise(F.array(strip(F.col("article"))))).alias("turn", "number")).filter("number != ''")
    own = docs.join(asked.select("id").distinct(), "id", "left_semi")
    parts = stored(sections(own), "sections")
    place = F.struct("start", "end", "piece")
    by_heading = parts.filter(F.col("end") - F.col("start") >= LEAST).groupBy("id", "number").agg(F.min(place).alias("part"))
    heading = each.join(by_heading, ["id", "number"]).withColumn("found", F.lit("heading"))
    left = each.join(heading.select("citation_id", "id", "turn"), ["citation_id", "id", "turn"], "left_anti")
    wanted = left.select("id", "number").distinct().join(own.select("id", "text"), "id")
    number = F.concat(F.lit(r"\Q"), "number", F.lit(r"\E"))
    told = F.concat(F.lit(r"(?<![0-9-])(?:"), number, F.lit(r"-бап|(?:Статья|Бап|Article|Section)\s+"), number, F.lit(r"(?![0-9-]))"))
    at = F.when(F.regexp_like("text", told), F.char_length(F.split("text", told, 2)[0]))
    points = wanted.select("id", "number", at.alias("at")).filter("at is not null")
    mention = offsets.placed(parts, points, "at").select("id", "number", F.struct("met_piece.start", "met_piece.end", "met_piece.piece").alias("part"))
    both = heading.unionByName(left.join(mention, ["id", "number"]).withColumn("found", F.lit("mention")))
    best = both.groupBy("citation_id", "id").agg(F.min_by(F.struct("number", "found", "part"), -F.col("turn")).alias("x"))
    return best.select("citation_id", "id", "x.number", "x.found", "x.part.piece", "x.part.start", "x.part.end")


def _by_article(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Rung 4: the first fitting line among the first CONTEXT characters of the article."""
    where = stored(contexts(asked, docs), "contexts")
    own = docs.join(where.select("id").distinct(), "id", "left_semi")
    line = chunks.lines(own).select("id", F.col("start").alias("at"), strip(F.col("line")).alias("passage"), (F.char_length("line") - F.char_length(F.ltrim("line"))).alias("lead"))
    line = line.filter(F.char_length("passage") > LINE)
    # the same line twice in a document is no place
    once = line.groupBy("id", F.xxhash64("passage").alias("h"), F.md5("passage").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.first("at").alias("at"), F.first("lead").alias("lead"), F.first("passage").alias("passage")).filter("n = 1")
    once = once.filter(~F.col("passage").rlike(ARTICLES.replace("(?m)^", r"\A"))).select("id", "at", "lead", "passage")
    met = offsets.placed(sections(own), once, "at").filter(F.col("at") < F.col("met_piece.start") + CONTEXT)
    first = met.groupBy("id", F.col("met_piece.piece").alias("piece")).agg(F.min(F.struct("at", "lead", "passage")).alias("x"))
    return where.join(first, ["id", "piece"]).select("citation_id", "id", F.lit("article").alias("rung"), (F.col("x.at") + F.col("x.lead")).alias("start"), "x.passage")
