"""Packing of token sequences: shortest pack first over the length histogram.

The histogram has at most `capacity` entries whatever the number of pieces, so the packing itself runs on the
driver over counts: lengths are placed longest first, each into the shortest packs that have room, a count of
equal packs at a time.  The result is a list of packing patterns with counts.  Pieces of one length are ranked
in a distributed way (within salted parts, plus the parts' offsets) and each pattern takes a range of ranks of
each of its lengths; that range table is joined back by length and rank.

Documents longer than the capacity are cut there; each id lies in exactly one piece.

Defined results.  A null text is an empty one: one piece with the end id alone.  Repeated rows are separate
documents.  A very long text is encoded whole, in spans, and cut into pieces that are dealt to parts each by itself, as are
those of null doc_ids.  Only the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, require, stored

CAPACITY = 2048
STEP = 256
#: Slots of the token memo: half the usual; after other stages, which leave less memory, fewer.
MEMO, LESS_MEMO = 1 << 20, 1 << 19


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY, slots: int = MEMO) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each whole text's ids and end id, cut at the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm.token_cache import encoder

        code = encoder(tokenizer, kind, slots)
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        types = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                rows: list[tuple] = []
                ids = code.encode_all([t or "" for t in part.column("text").to_pylist()])
                for doc, raw in zip(part.column("doc_id").to_pylist(), ids):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        own = raw[4 * s : 4 * (s + capacity)]
                        rows.append((doc, s, len(own) // 4, n, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return require(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), count)]: packs of the histogram, by shortest pack first, longest length first."""
    room: dict[int, list[list]] = defaultdict(list)  # by free space: [pattern, count]
    open_spaces: list[int] = []  # those in room, ascending; its last is the shortest pack's
    from bisect import insort

    def add(free: int, pattern: tuple, count: int) -> None:
        if not room[free]:
            insort(open_spaces, free)
        room[free].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit in {capacity}")
        while left:
            free = open_spaces[-1] if open_spaces else -1
            if free >= length:
                pattern, count = room[free][-1]
                taken = min(left, count)
                if taken == count:
                    room[free].pop()
                    if not room[free]:
                        open_spaces.pop()
                else:
                    room[free][-1][1] -= taken
                more = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                add(free - length, more, taken)
                left -= taken
                continue
            times = capacity // length
            if left >= times:
                add(capacity - times * length, ((length, times),), left // times)
            if left % times:
                add(capacity - left % times * length, ((length, left % times),), 1)
            left = 0
    merged: dict[tuple, int] = defaultdict(int)
    for free in open_spaces:
        for pattern, count in room[free]:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def rank_ranges(packs: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, times in a pack, offset in the pack) for each pattern's lengths."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in packs:
        at = 0
        for length, times in pattern:
            out.append((length, used[length], used[length] + count * times, sequence, times, at))
            used[length] += count * times
            at += length * times
        sequence += count
    return out


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """All columns of rows (a stored table with a column length) and sequence_id, offset.

    `order` names the columns that order pieces of equal length and deal them into parts; pieces that agree in all of them
    (repeated rows) are in any order.  Other columns come along.
    """
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = rank_ranges(patterns(counts, capacity))
    table = spark.createDataFrame(ranges, "p_length long, lo long, hi long, base long, times long, at long")
    salted = rows.withColumn("p_part", F.pmod(F.xxhash64(*order), F.lit(4 * partitions(spark))).cast("int"))
    parts = salted.groupBy("length", "p_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(parts.select("length", "p_part", F.coalesce(before, F.lit(0)).alias("p_before")), "pack-offsets")
    ranked = salted.withColumn("p_row", F.row_number().over(Window.partitionBy("length", "p_part").orderBy(*order)))
    ranked = ranked.join(offsets, ["length", "p_part"]).withColumn("p_rank", F.col("p_before") + F.col("p_row") - 1)
    #: One row for each length of each pattern: it depends on the capacity and not on the number of pieces.
    fits = (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("lo")) & (F.col("p_rank") < F.col("hi"))
    i = F.col("p_rank") - F.col("lo")
    return ranked.join(F.broadcast(table), fits).select(
        *rows.columns,
        (F.col("base") + F.floor(i / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(i, F.col("times")) * F.col("length")).alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): packed pieces put together; a sequence holds `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        "n_tokens",
        F.transform("p", lambda x: x.doc_id).alias("doc_ids"),
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.ids)).alias("ids"),
    )
