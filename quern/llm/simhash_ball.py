"""SimHash near-duplicate groups by meet-in-the-middle ball hashing, split over the two halves of a word.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their 32-bit
halves.  So every fingerprint emits, for each half, that half and all its variants within half the radius
(one bit; of two neighbours only the one that lacks the bit needs to emit it), the variants are shuffled to
the fingerprints that hold them exactly, and colliding pairs are verified on all 64 bits.  Emitting the
whole-word ball instead would take 2081 variants a fingerprint, which no disk budget holds.

Fingerprints that share a half with more than `crowd` others are not compared pair by pair.  There a second
ball is hashed over the other half: holders emit their variants within two bits, visitors (one bit away in the
first half) their exact value.  Every member of such a cell lies within three bits of any visitor and of any
holder within one bit of the cell, so linking all to one such hub gives the same components, in linear work.

Defined results.  A null text counts as a text without words, whose fingerprint is zero and links like any
other.  A text of one or two words is one shingle.  Rows with equal doc_id are separate members; a null doc_id
never becomes a component's id unless all members lack one.  Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, partitions, require, small, stored

SEED = 42
#: Pieces of a long text whose shingles are held as bits at one time.
BLOCK = 1 << 15
#: Holders of one half up to which pairs are compared directly.
CROWD = 32
_LOW = 0xFFFFFFFF


def simhash(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the shingles' hashes."""
    from xxhash import xxh64_digest

    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        n = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        raw = b"".join(map(xxh64_digest, (next(shingles) for _ in range(size)) if n > BLOCK else shingles, repeat(SEED)))
        ones += bit_sums(np.frombuffer(raw, np.uint8).reshape(-1, 8))
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit."""
    whole = len(rows) // 255 * 255
    bits = np.unpackbits(rows, axis=1)
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 bits fit in a byte, which is much faster than wide sums
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, from shingles of so many words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return require(docs, "doc_id", "text").select("doc_id", of("text").alias("fp"))


def _halves(fp: Column) -> list[tuple[int, Column, Column]]:
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 32)
    return [(0, low, high), (1, high, low)]


def _key(side: int, half: Column) -> Column:
    return half.bitwiseOR(F.lit(side << 32))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect just those within three bits."""
    holders = nodes.select(
        "fp", F.explode(F.array(*(F.struct(_key(s, h).alias("k"), o.alias("other")) for s, h, o in _halves(F.col("fp"))))).alias("x")
    ).select("fp", "x.k", "x.other")
    crowded = holders.groupBy("k").count().filter(F.col("count") > crowd).select("k")
    own = stored(holders.join(crowded.withColumn("many", F.lit(True)), "k", "left"), "simhash-holders")

    variants = [
        F.when(h.bitwiseAND(F.lit(1 << j)) == 0, _key(s, h).bitwiseOR(F.lit(1 << j))) for s, h, _ in _halves(F.col("fp")) for j in range(32)
    ]
    visits = nodes.select(F.col("fp").alias("guest"), F.explode(F.array(*variants)).alias("k")).filter("k is not null")
    same = own.filter("many is null").select(F.col("fp").alias("guest"), "k")
    hosts = own.filter("many is null").select("k", "fp").union(
        own.filter("many").select("k", F.lit(None).cast("long").alias("fp")).distinct()
    )
    met = (
        visits.union(same)
        .join(hosts, "k")
        .filter(F.col("fp").isNull() | ((F.col("fp") != F.col("guest")) & (_distance(F.col("fp"), F.col("guest")) <= 3)))
        .select("k", "guest", "fp")
    )
    met = stored(met, "simhash-met")
    near = met.filter("fp is not null").select(F.col("guest").alias("a"), F.col("fp").alias("b"))

    masks = [0] + [1 << i for i in range(32)] + [1 << i | 1 << j for i in range(32) for j in range(i)]
    other = F.when(F.col("k") >= (1 << 32), F.col("guest").bitwiseAND(F.lit(_LOW))).otherwise(F.shiftrightunsigned("guest", 32))
    cells = (
        own.filter("many")
        .select("fp", "k", "other", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
        .select("fp", "k", F.col("other").bitwiseXOR(F.col("mask")).alias("cell"), (F.bit_count("mask") <= 1).alias("hub"))
        .union(met.filter("fp is null").select(F.col("guest"), "k", other, F.lit(True)))
    )
    hubs = cells.filter("hub").groupBy("k", "cell").agg(F.min("fp").alias("b"))
    crowd_links = cells.select(F.col("fp").alias("a"), "k", "cell").join(hubs, ["k", "cell"]).filter("a <> b").select("a", "b")
    return near.union(crowd_links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (a, b), by label propagation with jumps.

    Nothing but a count reaches the driver; each round's labels are written to the shared folder.
    """
    # each node's links with smaller ones become one with the least of them, and links among those, which crowds share
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).withColumn("m", F.min("a").over(Window.partitionBy("b")))
    few = stored(up.select(F.col("m").alias("a"), "b").union(up.filter("a <> m").select("m", "a")).distinct(), "links-few")
    both = stored(few.union(few.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    for _ in range(max_rounds):
        told = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .select(F.col("a").alias("node"), "root")
            .union(labels)
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        told = stored(told, "labels")
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = told.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = stored(new, "labels")
        moved = new.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        discard(told, labels)
        labels = new
        if not moved:
            discard(both, few)
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _grouped(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from documents' fingerprints, the distinct ones with their least doc_id, and roots (node, root)."""
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stored(member, "simhash-members")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(member.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most three bits reach, itself included."""
    prints = stored(fingerprints(docs, words), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    return _grouped(prints, nodes, components(links(nodes.select("fp"), crowd)))


# Similarity instead of a radius.
#
# Two texts whose sets of shingles have a Jaccard similarity J differ in a share acos(2J / (1 + J)) / pi of their
# SimHash bits: 15 % at J = 0.8, far over three of 64.  So the fingerprint is made wider (words of 64 bits) and cut
# into bands; in each band the ball is hashed whole: everybody emits all variants within one bit, so pairs within
# two bits in some band meet in the middle.  Bands are long enough that a chance meeting is rare for the number of
# texts, and as many as a pair at the wanted similarity needs to meet with RECALL.
#
# What meets is joined loosely, by signatures, to groups that hold nearly all pairs of the wanted similarity.  Within
# a loose group all pairs are compared, those that may be similar by the exact Jaccard similarity of their shingles.
#
# Groups of any size are joined without gathering them (`resolved`): a large one is dealt to parts of LIMIT rows, each
# part is joined on its own, and then each row outside the group's largest class meets all rows of the group, in
# blocks.  Two rows of different classes are not both of the largest, so no pair is left out.

RECALL = 0.985
#: Standard deviations by which a pair at the similarity may differ more in CHECKED bits or in the whole signature.
DEVIATIONS = 3.7
#: By how much less similar texts with one value of a band are joined loosely, so that a crowd of near copies is one
#: loose group at once; the exact similarity separates them again.
SLACK = 0.2
#: Bits of a band: so many, or log2(n) for more texts; then few of its values are held by chance.
BAND_BITS = 20
#: Words at least; the similarity is estimated from all bits, with a standard error of 0.03 at 512 bits.
LEAST_WORDS = 8
#: Up to one more text than this that share a variant are compared pair by pair on CHECKED bits, then on whole signatures.
#: Of more (chance holders are fewer, by the choice of bits), and where pairs are more than the texts in them, all texts that any
#: pair holds are a crowd: its signatures are joined by `resolved`.  So no variant gives more rows than it has texts.
NEIGHBOURS = 48
#: Rows of a group that one task gathers.
LIMIT = 4096
#: Shingles looked up at one time.
_AT_ONCE = 22


def bit_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_plan(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n texts."""
    bits = max(BAND_BITS, math.ceil(math.log2(max(n, 2))))
    p = bit_share(similarity)
    meet = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(3))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def signature(text: str | None, words: int, wide: int) -> bytes:
    """`wide` SimHash words of 64 bits from shingles of so many words; zeros for a text without words."""
    from xxhash import xxh64_digest

    found = text.encode().lower().split() if text else []
    if not found:
        return bytes(8 * wide)
    if len(found) < words:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(found[i:] for i in range(words)))), len(found) - words + 1
    ones = np.zeros(64 * wide, np.int64)
    steps = np.arange(wide, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, n, BLOCK // 8):
        size = min(BLOCK // 8, n - start)
        raw = b"".join(map(xxh64_digest, (next(shingles) for _ in range(size)), repeat(SEED)))
        h = np.frombuffer(raw, ">u8").astype(np.uint64)[:, None] + steps
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        ones += bit_sums((h ^ h >> np.uint64(31)).view(np.uint8))
    return np.packbits(ones * 2 > n).tobytes()


def _band_keys(signatures: list[bytes], bits: int, bands: int) -> np.ndarray:
    """(texts, bands * (bits + 1)) keys: a hash of band and value for each band's value and its variants of one bit."""
    all_bits = np.unpackbits(np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1), axis=1)[:, 64:]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    flips = np.concatenate(([np.uint64(0)], weights))
    out = np.empty((len(signatures), bands, bits + 1), np.uint64)
    for b in range(bands):
        value = all_bits[:, b * bits : (b + 1) * bits].astype(np.uint64) @ weights
        out[:, b] = (value[:, None] ^ flips) * np.uint64(bands) + np.uint64(b)
    return out.reshape(len(signatures), -1).view(np.int64)


def _apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which signatures (rows of 64-bit words) differ from one."""
    return np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int64)


def _spanning(root: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links of each root with the least of those it is joined with, by any pair of rows; linked(row, rows) says which.

    Rows of one root count as linked.  Each row is compared with all that are not yet reached, so nothing is left out.
    Links with the least root are the same ones wherever the same rows meet again.
    """
    kind = np.unique(root, return_inverse=True)[1]
    a, b, todo = [], [], np.arange(len(root))
    while len(todo):
        own = kind[todo] == kind[todo[0]]
        met, todo = todo[own], todo[~own]
        queue, parts = met.tolist(), [met[:1]]
        while queue and len(todo):
            row = queue.pop()
            hit = todo[linked(row, todo)]
            if len(hit):
                reached = np.isin(kind[todo], kind[hit])
                parts.append(todo[reached])
                queue += todo[reached].tolist()
                todo = todo[~reached]
        joined = np.unique(root[np.concatenate(parts)])
        a.append(np.full(len(joined) - 1, joined[0]))
        b.append(joined[1:])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of batches sorted by key, in tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        start = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks()
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])


def _words(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, wide)


#: A table of gathered rows -> a function linked(row, rows) that says which rows a row is linked with.
Judge = Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]


def _crossing(kind: np.ndarray, pivots: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of links that join all kinds which any pair of a pivot and a row links."""
    kind, (a, b), rows = kind.copy(), ([], []), np.arange(len(kind))
    for row in pivots.tolist():
        others = rows[kind != kind[row]]
        hit = others[linked(row, others)] if len(others) else others
        if len(hit):
            kinds, at = np.unique(kind[hit], return_index=True)
            a += [row] * len(kinds)
            b += hit[at].tolist()
            kind[np.isin(kind, kinds)] = kind[row]
    return np.array(a, np.int64), np.array(b, np.int64)


def _joined(rows: DataFrame, judge: Judge) -> DataFrame:
    """(a, b): links of roots from rows (key, root, pivot, ...) such that each key's rows are joined: all with all, or pivots with all."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, "key"):
            key, root, pivot = (table.column(c).to_numpy() for c in ("key", "root", "pivot"))
            start = _starts(key)
            mixed = np.flatnonzero(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start))
            if not len(mixed):
                continue
            a, b = [], []
            for lo, hi in zip(start[mixed].tolist(), np.append(start, len(key))[mixed + 1].tolist()):
                own, linked = root[lo:hi], judge(table.slice(lo, hi - lo))
                first = np.flatnonzero(pivot[lo:hi] > 0)
                if len(first):
                    x, y = (own[i] for i in _crossing(own, first, linked))
                else:
                    x, y = _spanning(own, linked)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolved(rows: DataFrame, judge: Judge, limit: int = LIMIT) -> DataFrame:
    """(a, b): links of roots, from rows (key, root, ...), that join all roots which the judge links in some key.

    Rows of one root count as linked.  rows is read up to three times and must be the same each time.
    """
    crowd = stored(rows.groupBy("key").count().filter(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).alias("parts")), "simhash-crowds")
    names = [c for c in rows.columns if c != "key"]
    deal = lambda *by: F.pmod(F.xxhash64(*names), *by)  # noqa: E731  copies of a row lie in one part and need not meet
    mixed = lambda *by: F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", *by)).alias("key")
    dealt = rows.join(crowd, "key", "left").withColumn("part", deal("parts"))
    links = stored(_joined(dealt.select(mixed("part"), *names, F.lit(0).alias("pivot")), judge), "simhash-joined")
    if not crowd.limit(1).count():
        return links
    root = components(links).select(F.col("node").alias("root"), F.col("root").alias("next"))
    left = rows.join(crowd, "key").join(root, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")
    classes = left.groupBy("key", "root").count()
    sizes = classes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("classes"))
    blocks = F.ceil((F.col("n") - F.col("most.count")) / limit).alias("blocks")
    open_ = stored(sizes.filter("classes > 1").select("key", F.col("most.root").alias("largest"), blocks), "simhash-open")
    left = left.join(open_, "key")
    every = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", deal("parts")).withColumn("pivot", F.lit(0))
    some = left.filter("root <> largest").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    some = some.withColumn("block", deal("blocks")).withColumn("pivot", F.lit(1))
    met = every.unionByName(some).select(mixed("part", "block"), *names, "pivot")
    return links.union(stored(_joined(met, judge), "simhash-crossed"))


def _by_signature(wide: int, most: int) -> Judge:
    """Rows whose signatures differ in `most` bits at most."""

    def judge(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        sig = _words(table.column("sig"), wide)
        return lambda row, others: _apart(sig[row], sig[others]) <= most

    return judge


#: Bits of the first and the last word of a signature by which pairs are told apart where they meet; the first word's bits below FLIP hold the flip.
CHECKED = 120
FLIP = 8


def _meetings(key: np.ndarray, root: np.ndarray, tag: np.ndarray, last: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole keys sorted by key, node: pairs of rows (a, b) of different roots within `near` bits, and the rows of crowds, to be compared all with all.

    The low bits of a tag, the flip, say which bit of its band a row has changed (0: none).  Two values of a band meet as balls in two variants;
    so that each pair counts once, the earlier row must have the smaller flip.  (Equal values met before.)  Each such pair is told or within a crowd.
    """
    start = _starts(key)
    size = np.diff(np.append(start, len(key)))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    place = np.arange(len(key)) - np.repeat(start, size)
    flip, word = tag & (1 << FLIP) - 1, tag.view(np.uint64) >> np.uint64(FLIP)
    last = last.view(np.uint64)
    apart = lambda x, y: np.bitwise_count(word[x] ^ word[y]) + np.bitwise_count(last[x] ^ last[y])

    rows = np.flatnonzero(np.repeat(mixed & (size <= NEIGHBOURS + 1), size))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, NEIGHBOURS + 1):
        rows = rows[place[rows] >= s]
        if not len(rows):
            break
        others = rows - s
        hit = (root[rows] != root[others]) & (flip[others] < flip[rows]) & (apart(rows, others) <= near)
        a.append(others[hit])
        b.append(rows[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    group = np.repeat(np.arange(len(start)), size)
    held = np.unique(np.concatenate((a, b)))
    many = np.bincount(group[a], minlength=len(start)) > np.bincount(group[held], minlength=len(start))
    crowd = np.zeros(len(key), bool)
    crowd[held[many[group[held]]]] = True
    a, b = (x[~many[group[a]]] for x in (a, b))

    crowd |= np.repeat(mixed & (size > LIMIT), size)
    for g in np.flatnonzero(mixed & (size > NEIGHBOURS + 1) & (size <= LIMIT)).tolist():
        whole = np.arange(start[g], start[g] + size[g])
        _, kind, n = np.unique(root[whole], return_inverse=True, return_counts=True)
        for row in whole[kind != n.argmax()].tolist():  # of two roots one is not the most frequent
            hit = (root[whole] != root[row]) & np.where(whole > row, flip[whole] > flip[row], flip[whole] < flip[row])
            hit = whole[hit & (apart(whole, row) <= near)]
            if len(hit):
                crowd[hit] = crowd[row] = True
    return a, b, np.flatnonzero(crowd)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text without words has one of its own."""
    from xxhash import xxh64_digest

    found = text.encode().lower().split() if text else []
    if len(found) < words:
        parts = iter([b" ".join(found)])
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(SEED))), ">i8").astype(np.int64))


def _by_shingles(wide: int, most: int, similarity: float) -> Judge:
    """Rows whose sets of shingles have the similarity, of those whose signatures differ in `most` bits at most."""

    def judge(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        sig, sets = _words(table.column("sig"), wide), [np.frombuffer(x, np.int64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        start = np.cumsum(size) - size
        mark = np.zeros(int(ids.max()) + 1, np.int32)

        def linked(row: int, others: np.ndarray) -> np.ndarray:
            out = _apart(sig[row], sig[others]) <= most
            close = np.flatnonzero(out)
            if not len(close):
                return out
            own = ids[start[row] : start[row] + size[row]]
            mark[own] = 1
            for part in np.split(close, np.flatnonzero(np.diff(np.cumsum(size[others[close]]) >> _AT_ONCE)) + 1):
                texts = others[part]
                n = size[texts]
                begin = np.cumsum(n) - n
                both = np.add.reduceat(mark[ids[np.repeat(start[texts] - begin, n) + np.arange(n.sum())]], begin)
                out[part] = both >= similarity * (len(own) + n - both) - 1e-9
            mark[own] = 0
            return out

        return linked

    return judge


def _exact_roots(loose: DataFrame, docs: DataFrame, words: int, similarity: float, wide: int, most: int) -> DataFrame:
    """(node, root) of the nodes (fp, sig, digest, root) whose loose groups have several, by exact similarity of their texts.

    The shingles of a node are those of the text that its digest names, and stored once.
    """
    many = loose.join(loose.groupBy("root").count().filter("count > 1").select("root"), "root")
    many = stored(many.select("root", "fp", "sig", "digest"), "simhash-loose")
    texts = docs.select(text_digest().alias("digest"), "text").join(small(many.select("digest")), "digest", "left_semi")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of the texts of a task, without its repeated ones; its memory is bounded by its part of the texts."""
        seen: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                part = part.filter(pa.array([x not in seen and not seen.add(x) for x in part.column("digest").to_pylist()], pa.bool_()))
                sets = pa.array([shingles(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("digest"), sets], ["digest", "set"])

    sets = texts.mapInArrow(once, "digest string, set binary").groupBy("digest").agg(F.any_value("set").alias("set"))
    rows = many.join(sets, "digest").select(F.col("root").alias("key"), F.col("fp").alias("root"), "sig", "set")
    rows = stored(rows, "simhash-sets", texts=True)
    return components(resolved(rows, _by_shingles(wide, most, similarity)))


def text_digest() -> Column:
    """128 bits of a column text; null is a text of its own."""
    return F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, group, component_id): the smallest doc_id that links of at least the similarity reach, itself included.

    Equal texts (digest) are one node.  group is a number of the component, also where all its doc_ids are null.  A
    pair meets with the stated recall; a group of copies has many.  Pairs of a loose group are linked by the exact
    similarity of their shingles.
    """
    rows = require(docs, "doc_id", "text")
    bits, bands = band_plan(rows.count(), similarity)
    wide = max(LEAST_WORDS, 1 + -(-bits * bands // 64))
    allowed = lambda n, j: math.ceil(n * bit_share(j) + DEVIATIONS * math.sqrt(n * bit_share(j) * (1 - bit_share(j))))
    near, most, loosely = allowed(CHECKED, similarity), allowed(64 * wide, similarity), allowed(64 * wide, max(similarity - SLACK, 0.0))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [signature(t, words, wide) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.binary()), part.column("digest")], ["doc_id", "sig", "digest"])

    prints = stored(rows.withColumn("digest", text_digest()).mapInArrow(sign, "doc_id long, sig binary, digest string"), "simhash-wide", texts=True)
    texts = stored(prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.any_value("sig").alias("sig")), "simhash-texts")
    for seed in range(100):  # until no two texts share a number; the first try but for huge corpora
        nodes = stored(texts.withColumn("fp", F.xxhash64(F.lit(seed), "digest")), "simhash-nodes")
        if not nodes.groupBy("fp").count().filter("count > 1").limit(1).count():
            break
        discard(nodes)
    discard(texts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_words(batch.column(c), wide) for c in ("sig_a", "sig_b"))
            yield batch.select(["root_a", "root_b"]).filter(pa.array(_apart(x, y) <= most))

    # first those that agree on a whole band; then the balls link only what is not yet linked, so that a crowd of
    # near copies does not meet in all of its bands
    same = resolved(_band_rows(nodes, bits, bands), _by_signature(wide, loosely))
    rooted = stored(_rooted(nodes.withColumn("root", F.col("fp")), components(same)), "simhash-rooted")
    met = stored(_ball_meetings(rooted, bits, bands, near), "simhash-meetings")
    a, b = (rooted.select(*(F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", "sig"))) for x in "ab")
    pairs = met.filter("b is not null").select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).distinct()
    pairs = pairs.join(a, "fp_a").join(b, "fp_b").select("root_a", "root_b", "sig_a", "sig_b")
    crowds = met.filter("b is null").select("key", F.col("a").alias("fp")).join(rooted.select("fp", "root", "sig"), "fp").select("key", "root", "sig")
    more = pairs.mapInArrow(verify, "root_a long, root_b long").union(resolved(crowds, _by_signature(wide, most))).toDF("a", "b")
    loose = stored(_rooted(rooted, components(stored(more.distinct(), "simhash-more"))), "simhash-grouped")
    roots = _exact_roots(loose, rows, words, similarity, wide, most)
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("digest", "least", F.coalesce("root", "fp").alias("group"))
    member = stored(member, "simhash-members")
    ids = member.groupBy("group").agg(F.min("least").alias("component_id"))
    of = stored(member.join(ids, "group").select("digest", "group", "component_id"), "simhash-components")
    return prints.join(of, "digest").select("doc_id", "digest", "group", "component_id")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with their root replaced by its own root (node, root) where it has one."""
    told = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return nodes.join(told, "root", "left").select("fp", "sig", "digest", F.coalesce("next", "root").alias("root"))


def _band_rows(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, root, sig): a row for each band's value of the nodes (root, sig)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = _band_keys(part.column("sig").to_pylist(), bits, bands)[:, :: bits + 1]
                place = pa.array(np.repeat(np.arange(len(keys)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("root").take(place), part.column("sig").take(place)], ["key", "root", "sig"])

    return nodes.select(F.col("fp").alias("root"), "sig").mapInArrow(emit, "key long, root long, sig binary")


def _ball_meetings(nodes: DataFrame, bits: int, bands: int, near: int) -> DataFrame:
    """(key, a, b): pairs of nodes (fp, sig, root) to verify that share a variant, and each node of a crowd, b null, with its key."""
    names = ["key", "fp", "root", "tag", "last"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sig = part.column("sig").to_pylist()
                keys = _band_keys(sig, bits, bands)
                word = np.frombuffer(b"".join(x[:8] for x in sig), ">u8").astype(np.uint64) & ~np.uint64((1 << FLIP) - 1)
                last = np.frombuffer(b"".join(x[-8:] for x in sig), np.int64)
                tag = (word[:, None] | (np.arange(keys.shape[1]) % (bits + 1)).astype(np.uint64)).ravel().view(np.int64)
                fp, root, last = (np.repeat(x, keys.shape[1]) for x in (part.column("fp").to_numpy(), part.column("root").to_numpy(), last))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), fp, root, tag, last)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, "key"):
            key, fp, root, tag, last = (table.column(c).to_numpy() for c in names)
            a, b, crowd = _meetings(key, root, tag, last, near)
            pairs = np.unique(np.stack((fp[a], fp[b]), axis=1), axis=0)
            other = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(crowd), pa.int64())])
            keys = np.concatenate((np.zeros(len(pairs), np.int64), key[crowd]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate((pairs[:, 0], fp[crowd]))), other], ["key", "a", "b"])

    dealt = nodes.select("fp", "sig", "root").repartition(partitions(nodes.sparkSession)).mapInArrow(emit, "key long, fp long, root long, tag long, last long")
    dealt = dealt.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(meet, "key long, a long, b long")
