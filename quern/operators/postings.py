"""Postings of passages: counted text by text in one pass, and an index of them in blocks of falling impact.

`counted` tokenises each passage once, in Arrow batches, and gives its terms with their frequencies; no token is ever shuffled.
`scored` adds up all scores of a set of queries in the tasks that hold the passages.
`index` turns them into blocks: postings of a term whose impact (what the term adds to BM25, without its idf) lies in one of LEVELS
bands, dealt by a hash of the passage to blocks of about BLOCK rows, with the block's largest impact as its bound.

`best` finds the k passages of largest score without reading most blocks.  A query's bands are taken from the strongest on until
they hold enough postings; what they add up to in each passage is a lower bound of its score, and the k-th largest is a floor for
the query.  Passages that can still beat the floor must have a posting outside of the weakest bands, whose bounds together stay below it
(a band for each term).  Only the bands above are read for candidates; candidates whose sum cannot reach the floor go, and only for
the others the weak bands are looked up.  Results are those of summing all postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.tables import spread, stored

K1, B = 1.5, 0.75
LEVELS, BLOCK = 16, 4096
#: Terms of queries that are sent to the tasks that count; with more, a join filters the counts.
ASKED = 300_000
#: Postings that a query reads for its floor, as a multiple of k.
FIRST = 20

_WORDS = re.compile(r"[\wЀ-ӿ؀-ۿ一-鿿]{2,}|\d")
_HAN = re.compile("[一-鿿]")


def term_counts(lower: str) -> Counter:
    """Tokens of a lower-case text as `functions.text.bag` has them, with their frequencies."""
    words = Counter(_WORDS.findall(lower))
    out = Counter(words)
    for word, n in words.items():
        if len(word) >= 6 and not word.isdecimal():
            out["#" + word[:5]] += n
        if len(word) >= 2 and _HAN.search(word):
            for i in range(len(word) - 1):
                out[word[i : i + 2]] += n
    return out


def counted(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, term, tf), stored: of given terms only where there are some.  Each passage has a row of term '' too."""
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    known = None
    if terms is not None:
        asked = terms.select("term").distinct()
        rows = asked.limit(ASKED + 1).collect()
        if len(rows) <= ASKED:
            known = corpus.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                place, length, term, tf = [], [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    found = term_counts(text) if text else Counter()
                    total = sum(found.values())
                    own = found.keys() if wanted is None else found.keys() & wanted
                    term += own
                    tf += [found[t] for t in own]
                    term.append("")
                    tf.append(1)
                    place += [i] * (len(own) + 1)
                    length += [total] * (len(own) + 1)
                yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(place, pa.int64())), pa.array(length, pa.int32()), pa.array(term), pa.array(tf, pa.int64())], ["chunk_id", "length", "term", "tf"])

    out = spread(corpus.select("chunk_id", "text")).select("chunk_id", F.lower("text").alias("t")).mapInArrow(count, f"chunk_id {kind}, length int, term string, tf long")
    if terms is not None and known is None:
        out = out.join(asked.union(corpus.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi").select("chunk_id", "length", "term", "tf")
    return stored(out, "postings")


def scored(corpus: DataFrame, asked: DataFrame) -> DataFrame | None:
    """(query_id, chunk_id, score): BM25 sums, unrounded, for queries' distinct terms (query_id, term); None if these are over ASKED rows.

    Each passage becomes one row with its frequencies of the asked terms, stored; document frequencies are of that table.  Then a
    task adds up its passages' scores for all queries that share a term, and nothing is shuffled.
    """
    pairs = asked.limit(ASKED + 1).collect()
    if len(pairs) > ASKED:
        return None
    context = corpus.sparkSession.sparkContext
    place = {t: i for i, t in enumerate(sorted({r["term"] for r in pairs}))}
    known = context.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                length, terms, tf = [], [], []
                for text in part.column("t").to_pylist():
                    found = term_counts(text) if text else Counter()
                    own = list(found.keys() & wanted.keys())
                    length.append(sum(found.values()))
                    terms.append([wanted[t] for t in own])
                    tf.append([found[t] for t in own])
                kinds = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.array(length, pa.int64()), pa.array(terms, kinds), pa.array(tf, kinds)], ["chunk_id", "length", "terms", "tf"])

    kind = corpus.schema["chunk_id"].dataType.simpleString()
    rows = spread(corpus.select("chunk_id", "text")).select("chunk_id", F.lower("text").alias("t")).mapInArrow(count, f"chunk_id {kind}, length long, terms array<int>, tf array<int>")
    rows = stored(rows, "counts")
    n, average = rows.agg(F.count("length"), F.avg("length")).first()
    frequency = np.zeros(len(place))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[r["t"]] = r["count"]
    weight = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    ids = sorted({r["query_id"] for r in pairs})
    number = {q: i for i, q in enumerate(ids)}
    by_term = np.array(sorted((place[r["term"]], number[r["query_id"]]) for r in pairs), np.int64).reshape(-1, 2)
    start = np.searchsorted(by_term[:, 0], np.arange(len(place) + 1))
    id_type = to_arrow_type(asked.schema["query_id"].dataType)
    shared = context.broadcast((by_term[:, 1].copy(), start, weight, ids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, start, weight, ids = shared.value
        names, step = pa.array(ids, id_type), max(1, (1 << 22) // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, tf = (part.column(c).flatten().to_numpy() for c in ("terms", "tf"))
                doc = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                norm = K1 * (1 - B + B * part.column("length").to_numpy()[doc] / average)
                value = weight[terms] * tf * (K1 + 1) / (tf + norm)
                many = start[terms + 1] - start[terms]
                end = np.cumsum(many)
                own = query[np.repeat(start[terms] - (end - many), many) + np.arange(int(end[-1]) if len(end) else 0)]
                cell = np.repeat(doc, many) * len(ids) + own
                total = np.bincount(cell, np.repeat(value, many), part.num_rows * len(ids))
                hit = np.flatnonzero(np.bincount(cell, minlength=len(total)))
                chunk, q = (pa.array(x) for x in np.divmod(hit, max(1, len(ids))))
                yield pa.RecordBatch.from_arrays([names.take(q), part.column("chunk_id").take(chunk), pa.array(total[hit])], ["query_id", "chunk_id", "score"])

    if not ids or not n:
        return corpus.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double")
    return rows.mapInArrow(add, f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double")


def stats(posted: DataFrame) -> DataFrame:
    """One row (n, avg_length): passages and their mean number of tokens."""
    return posted.filter("term = ''").agg(F.count("length").alias("n"), F.avg("length").alias("avg_length"))


def impact(tf: Column, length: Column, avg_length: Column) -> Column:
    """What a term adds to a passage's BM25, for an idf of 1: under K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def index(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored blocks (term, level, block, bound, chunk_ids, impacts) and bands (term, level, idf, bound, n), level 0 the strongest."""
    one = F.broadcast(stats(posted))  # a single row
    found = posted.filter("term <> ''").crossJoin(one)
    found = found.select("chunk_id", "term", "n", impact(F.col("tf"), F.col("length"), F.col("avg_length")).alias("impact"))
    level = F.least(F.lit(LEVELS - 1), F.floor((1 - F.col("impact") / (K1 + 1)) * LEVELS)).cast("int")
    found = stored(found.withColumn("level", level), "impacts")
    bands = stored(found.groupBy("term", "level").agg(F.max("impact").alias("bound"), F.count(F.lit(1)).alias("n"), F.first("n").alias("passages")), "bands")
    total = Window.partitionBy("term")
    bands = bands.withColumn("df", F.sum("n").over(total)).select("term", "level", idf(F.col("passages"), F.col("df")).alias("idf"), "bound", "n")
    # a frequent term's band is dealt to as many blocks as it needs; rare ones have a single block
    many = bands.filter(F.col("n") > BLOCK).select("term", "level", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = found.join(many, ["term", "level"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("parts")), F.lit(0)))
    pair = F.sort_array(F.collect_list(F.struct("impact", "chunk_id")), asc=False)
    blocks = dealt.groupBy("term", "level", "block").agg(F.max("impact").alias("bound"), pair.alias("rows"))
    blocks = blocks.select("term", "level", "block", "bound", F.col("rows.chunk_id").alias("chunk_ids"), F.col("rows.impact").alias("impacts"))
    return stored(blocks, "blocks"), stored(bands, "bands")


def _read(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, term, part) of the blocks of wanted bands (query_id, term, level, idf)."""
    each = blocks.join(wanted, ["term", "level"]).select("query_id", "term", "idf", F.explode(F.arrays_zip("chunk_ids", "impacts")).alias("x"))
    return each.select("query_id", F.col("x.chunk_ids").alias("chunk_id"), "term", (F.col("idf") * F.col("x.impacts")).alias("part"))


def _floored(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th largest sum of each query, to six decimals; 0 where there are fewer."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    kth = sums.withColumn("place", n).filter(F.col("place") <= k)
    return kth.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(0.0).alias("floor"))


def best(blocks: DataFrame, bands: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best passages (query_id, chunk_id, score, rank) for queries' distinct terms (query_id, term), ties to the smaller
    chunk_id, and (query_id, postings, read): the postings of a query's terms and how many of them were read."""
    own = stored(asked.join(bands, "term").withColumn("most", F.col("idf") * F.col("bound")), "asked-bands")
    strongest = Window.partitionBy("query_id").orderBy(F.desc("most"), "term", "level")
    running = F.sum("n").over(strongest.rowsBetween(Window.unboundedPreceding, -1))
    first = own.withColumn("before", F.coalesce(running, F.lit(0))).filter(F.col("before") < FIRST * k).drop("before")
    sums = _read(blocks, first.select("query_id", "term", "level", "idf")).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("low"))
    floors = stored(_floored(sums, k), "floors")
    # of each term the weakest bands may be left out, as long as what all left-out bands can add stays below the floor: the terms
    # that can add least go whole first, then the next one's weakest bands
    reach = own.groupBy("query_id", "term").agg(F.max("most").alias("most"))
    least = Window.partitionBy("query_id").orderBy("most", "term")
    reach = reach.withColumn("under", F.coalesce(F.sum("most").over(least.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("most")
    cut = own.join(reach, ["query_id", "term"]).join(F.broadcast(floors), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    weak = F.col("under") + F.col("most") < F.col("floor") - 2e-6  # scores are rounded
    cut = stored(cut.withColumn("weak", weak), "asked-cut")
    strong = _read(blocks, cut.filter("not weak").select("query_id", "term", "level", "idf"))
    lost = cut.filter("weak").groupBy("query_id", "term").agg(F.max("most").alias("more"))
    rest = cut.filter("weak").groupBy("query_id", "term").agg(F.max("most").alias("m")).groupBy("query_id").agg(F.sum("m").alias("rest"))
    low = strong.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("low"))
    low = stored(low, "candidates")
    again = _floored(low, k).withColumnRenamed("floor", "better")
    ahead = low.join(F.broadcast(rest), "query_id", "left").join(F.broadcast(again), "query_id").join(F.broadcast(floors), "query_id", "left")
    floor = F.greatest("better", F.coalesce("floor", F.lit(0.0)))
    ahead = stored(ahead.filter(F.col("low") + F.coalesce("rest", F.lit(0.0)) >= floor - 2e-6).select("query_id", "chunk_id", "low"), "ahead")
    # what the weak bands add to those that are left: their blocks are narrowed to the passages that are asked for
    missing = ahead.join(lost.select("query_id", "term"), "query_id").select("query_id", "chunk_id", "term")
    weak_bands = cut.filter("weak").select("query_id", "term", "level", "idf")
    few = blocks.join(weak_bands.select("term", "level").distinct(), ["term", "level"], "left_semi")
    rows = few.select("term", "level", F.explode(F.arrays_zip("chunk_ids", "impacts")).alias("x")).select("term", "level", F.col("x.chunk_ids").alias("chunk_id"), F.col("x.impacts").alias("impact"))
    rows = rows.join(ahead.select("chunk_id").distinct(), "chunk_id", "left_semi")
    more = rows.join(missing, ["term", "chunk_id"]).join(weak_bands, ["query_id", "term", "level"])
    more = stored(more.select("query_id", "chunk_id", (F.col("idf") * F.col("impact")).alias("low")), "weak-parts")
    score = F.round(F.sum("low"), 6).alias("score")
    scores = ahead.unionByName(more).groupBy("query_id", "chunk_id").agg(score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = scores.withColumn("rank", rank).filter(F.col("rank") <= k)
    read = cut.filter("not weak").groupBy("query_id").agg(F.sum("n").alias("strong"))
    looked = more.groupBy("query_id").agg(F.count(F.lit(1)).alias("looked"))
    counts = cut.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read, "query_id", "left").join(looked, "query_id", "left")
    return ranked, counts.select("query_id", "postings", (F.coalesce("strong", F.lit(0)) + F.coalesce("looked", F.lit(0))).alias("read"))
