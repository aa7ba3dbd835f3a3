"""Stupid-backoff scores of documents, from n-gram count tables of the whole corpus.

Words are the runs of other bytes than ASCII white space, with A-Z in lower case; every word and every n-gram counts,
known by a hash of 64 bits.  A text is scored by the other texts: c'(g) is the corpus' count of an n-gram less the
text's own (else no document of the corpus would ever back off).  For a word w after the words h, up to ORDER - 1 of
them (a text begins with <s>):

    S(w | h) = c'(h w) / c'(h)            if c'(h w) > 0
               ALPHA * S(w | h')          otherwise; h' is h without its first word
    S(w)     = max(c'(w), 1) / N          N is the number of words of the corpus

A document's score is the sum of ln S over its words.

Relations.  Texts are gathered to blocks of about BLOCK words, stored once as word ids.  Each block explodes to its
distinct n-grams with counts, so what is shuffled is pre-aggregated; they are dealt by a hash of the key to parts, PART
of them or so in each, as arrays of keys, counts and the block's own numbers for them (a row for each block and part).  A part sums its count table and
joins the n-grams to it; what other blocks hold of an n-gram comes back to its block (nothing does where they hold none),
which adds its own counts and takes the documents' sums.  SLICES parts of the key space are joined one after the other,
which divides the disk that the shuffle takes.  A frequent n-gram has one entry a block.

Defined results.  A null text has no words: score 0.  Rows with equal or null doc_id are separate documents.  A very
long text is a block of its own, held in memory by its task.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, require, stored

ORDER = 2
ALPHA = 0.4
SLICES = 3
#: Words of a block, about.
BLOCK = 1 << 19
#: Words of the corpus for each part of the n-grams, about.
PART = 1 << 19
STEP = 32
#: A row for each block: its documents, how many words each has, all their word ids, and the hashes of the words by id.
TABLE = "block long, docs array<long>, sizes array<long>, ids binary, words binary"
#: The place of <s> in every block's words.
START = 0


class _Index(dict):
    """Word -> its place among the block's words, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self) + 1
        return place


def _hashes(words: Iterator[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, n)


def _longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their histories and last words."""
    with np.errstate(over="ignore"):
        x = history * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _levels(ids: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 1 to order: (place of the last word, n-gram, history), for all words that have so long a history.

    n-grams and histories are numbers within the block; a history's are those of the length before, <s> itself is -1.
    """
    end = np.cumsum(sizes)
    before = np.arange(len(ids)) - np.repeat(end - sizes, sizes)  # words before this one in its text
    at = np.arange(len(ids))
    gram = np.unique(ids, return_inverse=True)[1].astype(np.int64) if len(ids) else ids.astype(np.int64)
    out = [(at, gram, np.zeros(0, np.int64))]
    for length in range(2, order + 1):
        own = at[before[at] >= length - 2]
        last = np.full(len(ids) + 1, -1, np.int64)
        last[out[-1][0]] = out[-1][1]  # the n-gram one shorter that ends at each word
        history = np.where(before[own] > 0, last[own - 1], -1) if length == 2 else last[own - 1]
        word = out[0][1][own]
        gram = np.unique((history + 1) * (int(out[0][1].max(initial=0)) + 1) + word, return_inverse=True)[1].astype(np.int64)
        out.append((own, gram, history))
        at = own
    return out


def _keys(words: np.ndarray, ids: np.ndarray, levels: list) -> list[np.ndarray]:
    """For each length the keys of its n-grams by number."""
    out = []
    for at, gram, history in levels:
        keys = np.zeros(int(gram.max(initial=-1)) + 1, np.uint64)
        if not out:
            keys[gram] = words[ids[at]]
        else:
            before = np.append(out[-1], words[START])  # of -1: <s>
            keys[gram] = _longer(before[history], words[ids[at]])
        out.append(keys)
    return out


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """TABLE of the documents' words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        index, held, names = _Index(), [], []

        def row() -> pa.RecordBatch:
            nonlocal index, held, names, number
            words = np.concatenate((_hashes(iter([b"<s> "]), 1), _hashes(iter(index), len(index))))
            values = [number, names, [len(x) for x in held], b"".join(x.tobytes() for x in held), words.tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            index, held, names, number = _Index(), [], [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "docs", "sizes", "ids", "words"])

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    found = (text or "").encode().lower().split()
                    names.append(doc)
                    held.append(np.fromiter(map(index.__getitem__, found), "<u4", len(found)))
                    total += len(found)
                    if total >= block:
                        yield row()
                        total = 0
        if names:
            yield row()

    return docs.mapInArrow(gather, TABLE)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, words of each document and word hashes of a block."""
    return np.frombuffer(row["ids"], "<u4"), np.array(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64)


def exploded(table: DataFrame, order: int, slice_: int, parts: int) -> DataFrame:
    """(part, block, keys, counts, grams): the distinct n-grams of each block in one of SLICES slices of the key space, by part.

    grams are the block's numbers of n-grams, those of one length after those of the length before.
    """
    names = ["part", "block", "keys", "counts", "grams"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, sizes, words = _read(row)
                levels = _levels(ids, sizes, order)
                keys = _keys(words, ids, levels)
                counts = np.concatenate([np.bincount(gram, minlength=len(k)) for k, (_, gram, _) in zip(keys, levels)])
                keys = np.concatenate(keys)
                mine = np.flatnonzero(keys % np.uint64(SLICES) == slice_)
                part = (keys[mine] // np.uint64(SLICES) % np.uint64(parts)).astype(np.int64)
                up = mine[np.argsort(part, kind="stable")]
                ends = np.cumsum(np.bincount(part, minlength=parts))
                own = np.flatnonzero(np.diff(ends, prepend=0))
                cut = list(zip(np.concatenate(([0], ends))[own].tolist(), ends[own].tolist()))
                keys, counts = keys[up], counts[up].astype("<u4")
                for at in range(0, len(own), 256):
                    arrays = [pa.array([x[a:b].tobytes() for a, b in cut[at : at + 256]], pa.binary()) for x in (keys, counts, up.astype("<u4"))]
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 256]), pa.array(np.full(len(arrays[0]), row["block"])), *arrays], names)

    return table.select("block", "sizes", "ids", "words").mapInArrow(explode, "part long, block long, keys binary, counts binary, grams binary")


def _thin(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def counted(grams: DataFrame) -> DataFrame:
    """(block, grams, counts): the numbers of the n-grams of each block that other blocks hold too, and how often they do."""

    def join(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        mine = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
        table = np.bincount(place, weights=mine, minlength=len(known)).astype(np.int64)
        count, at, out = table[place] - mine, 0, []
        for r, k in zip(rows, keys):
            own = count[at : at + len(k)]
            at += len(k)
            grams = np.frombuffer(r["grams"], "<u4")[own > 0].astype(np.int64)  # ascending
            out.append((_thin(np.diff(grams, prepend=0)), _thin(own[own > 0])))
        columns = [pa.array([r["block"] for r in rows]), *(pa.array(c, pa.binary()) for c in zip(*out))]
        return pa.RecordBatch.from_arrays(columns, ["block", "grams", "counts"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield join(held)
                    held = []
                held.append(row)
        if held:
            yield join(held)

    dealt = grams.repartition(partitions(grams.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(joined, "block long, grams binary, counts binary")


def _own_counts(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each n-gram of a list how often its document holds it there."""
    _, place, n = np.unique(doc * (int(gram.max(initial=0)) + 1) + gram, return_inverse=True, return_counts=True)
    return n[place]


def scored(ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray, counts: np.ndarray, total: int, texts: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(words whose longest n-gram is known, sum of ln S) for each text of a block.

    grams: the block's numbers of n-grams that other blocks hold too, and their counts there.
    """
    levels = _levels(ids, sizes, order)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    log_s, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
    rest, first = np.zeros(0), 0
    for length, (at, gram, history) in enumerate(levels, 1):
        count = np.bincount(gram)
        own = (grams >= first) & (grams < first + len(count))
        count[grams[own] - first] += counts[own]
        first += len(count)
        left = count[gram] - _own_counts(doc[at], gram)  # of this text's n-grams, in other texts
        if length == 1:
            log_s = np.log(np.maximum(left, 1)) - np.log(max(total, 1))
            rest = left.astype(np.float64)
        else:
            before = np.where(history < 0, texts - 1, rest[at - 1])
            hit = left > 0
            value = np.log(alpha) + log_s[at]
            value[hit] = np.log(left[hit]) - np.log(before[hit])
            log_s[at] = value
            seen[at] = hit
            rest[at] = left
    n = len(sizes)
    return np.bincount(doc, weights=seen, minlength=n).astype(np.int64), np.bincount(doc, weights=log_s, minlength=n)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, seen, score): words, those whose longest n-gram other texts hold, and the sum of ln S."""
    table = stored(blocks(require(docs, "doc_id", "text"), block), "lm-blocks")
    sizes = table.select(F.explode("sizes").alias("n")).agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("texts")).head()
    total, texts = sizes["total"] or 0, sizes["texts"]
    parts = max(1, -(-total // PART))
    found = None
    for slice_ in range(SLICES):
        some = stored(counted(exploded(table, order, slice_, parts)), "lm-found")
        found = some if found is None else found.union(some)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "seen", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names)
        row = left.to_pylist()[0]
        ids, sizes = np.frombuffer(row["ids"], "<u4"), np.array(row["sizes"], np.int64)
        none = [np.zeros(0, np.int64)]
        grams = np.concatenate([np.cumsum(_wide(x)) for x in right.column("grams").to_pylist()] or none)
        counts = np.concatenate([_wide(x) for x in right.column("counts").to_pylist()] or none)
        seen, sums = scored(ids, sizes, grams, counts, total, texts, order, alpha)
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(sizes), pa.array(seen), pa.array(sums)], names)

    return table.drop("words").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, seen long, score double")
