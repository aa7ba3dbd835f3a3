"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words; 10 consecutive words of an item are a window (an item of fewer words is one).  The
windows of all items are found by Spark and broadcast with their 64-bit hashes.  Tasks hash the words of their documents
and then every window of the lengths that occur by array operations, look them up, and compare the words themselves of
each hit with the item's window.  Words of verified windows are hit; `cleaned` removes their spans, or whole documents.

A broadcast holds at most PAIRS windows and BYTES bytes.  More are dealt by hash into parts that pass over the documents one
after the other, each adding its hits to those of the parts before.

Defined results.  A null or empty text, or one without words, has no hits; an item without words has no window.  Windows that several
items share count for each; items of equal item_id are one; the id of a null item_id is ''.  Overlapping windows hit a word
once.  Very long texts are read whole, in spans that overlap by a window.  Repeated documents are scanned each.  An
empty benchmark or table of documents gives no hits, or no rows.  Clashing names get underscores until they are free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import free_name, require, stored
from quern.llm.token_cache import Powers

#: Words of a window.
LENGTH = 10
#: Windows and their bytes that are broadcast at one time.
PAIRS, BYTES = 200_000, 32 << 20
#: Bytes of text handled at one time.
SPAN = 1 << 20

_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MIX = [pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) | 1 for j in range(64)]


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in normalised bytes."""
    word = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def windows(benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """The distinct pairs of a window (words joined by spaces), and an item's id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().translate(_TABLE).split() if text else []
                own = [b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))] if words else []
                for at in range(0, len(own), 10_000):
                    part = own[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], ["window", "item"])

    rows = require(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(of, "window binary, item string").distinct()


class Windows:
    """A part of the windows with their hashes, as workers use it."""

    def __init__(self, pairs: list[tuple[bytes, str]]) -> None:
        self.items: dict[bytes, list[str]] = {}
        for window, item in pairs:
            self.items.setdefault(window, []).append(item)
        self.powers = Powers(7)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        each: dict[int, list[bytes]] = {}
        for window in self.items:
            each.setdefault(window.count(b" ") + 1, []).append(window)
        for k, own in each.items():
            found = []
            for at in range(0, len(own), 1000):
                data = np.frombuffer(b" ".join(own[at : at + 1000]), np.uint8)
                found.append(self.hashes(self.words(data, *_bounds(data)), k)[::k])
            keys = np.unique(np.concatenate(found))
            shift = max(8, int(len(keys) * 16).bit_length())
            seen = np.zeros(1 << shift, bool)
            seen[(keys >> np.uint64(64 - shift)).astype(np.int64)] = True
            self.by_length[k] = keys, seen

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.powers.slices(data, start, end) + (end - start).astype(np.uint64)
        return (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)

    @staticmethod
    def hashes(words: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(words) - k + 1)
        found = np.zeros(n, np.uint64)
        for j in range(k):
            found += words[j : j + n] * np.uint64(_MIX[j % 64])
        return (found ^ found >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, raw: bytes, starts: list[int]) -> Iterator[tuple[int, int, int, list[str]]]:
        """Verified windows of normalised texts that begin at these places: the text's number, first word there, length, items."""
        data = np.frombuffer(raw, np.uint8)
        start, end = _bounds(data)
        words = self.words(data, start, end)
        first = np.searchsorted(start, starts)
        last = np.append(first[1:], len(start))
        for k, (keys, seen) in self.by_length.items():
            own = self.hashes(words, k)
            at = np.flatnonzero(seen[(own >> np.uint64(64 - seen.size.bit_length() + 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
            at = at[keys[place] == own[at]]
            text = np.searchsorted(first, at, "right") - 1
            fits = at + k <= last[text]
            for i, t in zip(at[fits].tolist(), text[fits].tolist()):
                items = self.items.get(b" ".join(raw[start[i] : end[i + k - 1]].split()))
                if items:
                    yield t, i - int(first[t]), k, items

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: words, runs of hit words (first, after the last), and items."""
        count, marks, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        group: list[tuple[int, int, bytes]] = []  # text, words before, normalised bytes
        held, longest = 0, max(self.by_length, default=1)

        def flush() -> None:
            if group and self.by_length:
                sizes = np.cumsum([0, *(len(raw) + 1 for _, _, raw in group)])[:-1]
                for t, i, k, own in self.find(b" ".join(raw for _, _, raw in group), sizes.tolist()):
                    doc, before, _ = group[t]
                    marks[doc].append((before + i, before + i + k))
                    items[doc].update(own)
            group.clear()

        for doc, text in enumerate(texts):
            for before, raw, n in _spans(text.translate(_TABLE) if text else b"", longest):
                if group and held + len(raw) > SPAN:
                    flush()
                    held = 0
                group.append((doc, before, raw))
                held += len(raw)
                count[doc] = before + n
        flush()
        return count, [_merged(m) for m in marks], items


def _spans(raw: bytes, longest: int) -> Iterator[tuple[int, bytes, int]]:
    """Words before, bytes and words of spans that are cut between words and overlap by longest - 1 words."""
    at = before = cut = 0
    while True:
        new = cut  # what stands before it are the last words of the span before
        cut = raw.find(b" ", new + SPAN) if len(raw) - new > SPAN else -1
        cut = len(raw) if cut < 0 else cut
        start, _ = _bounds(np.frombuffer(raw, np.uint8, cut - at, at)) if cut > at else ((), ())
        yield before, raw[at:cut], len(start)
        if cut >= len(raw):
            return
        keep = min(longest - 1, len(start))
        before, at = before + len(start) - keep, at + int(start[-keep]) if keep else cut


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, length: int = LENGTH, pairs: int = PAIRS) -> DataFrame:
    """The columns of docs (or those of keep) with a last one `leaks`: struct(n_words, runs of hit words, items in order of strings)."""
    known = stored(windows(benchmark, length), "windows")
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("window") + F.length("item")), F.lit(0))).first()
    parts = max(1, -(-n // pairs), -(-size // BYTES))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(parts)))
    keep = docs.columns if keep is None else keep
    name = free_name("leaks", docs.columns)
    run = T.ArrayType(T.StructType().add("first", "integer").add("after", "integer"))
    kind = T.StructType().add("n_words", "long").add("runs", run).add("items", T.ArrayType(T.StringType()))
    arrow = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), ("items", pa.list_(pa.string()))])
    rows, context = docs, docs.sparkSession.sparkContext
    for part in range(parts):
        own = [(bytes(r["window"]), r["item"]) for r in dealt.filter(F.col("part") == part).select("window", "item").collect()]
        shared, last = context.broadcast(own), part == parts - 1
        columns = [rows.columns.index(c) for c in (keep if last else docs.columns)]
        at_text, at_leaks = docs.columns.index("text"), len(docs.columns) if part else None
        rows = _pass(rows, shared, columns, at_text, at_leaks, name, kind, arrow)
        if not last:
            rows = stored(rows, "leaks")
    return rows


def _pass(rows: DataFrame, shared, columns: list[int], at_text: int, at_leaks: int | None, name: str, kind: T.StructType, arrow: pa.DataType) -> DataFrame:
    names = [rows.columns[i] for i in columns]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(shared.value)
        for batch in batches:
            count, runs, items = own.scan(batch.column(at_text).cast(pa.binary()).to_pylist())
            if at_leaks is not None:
                for i, old in enumerate(batch.column(at_leaks).to_pylist()):
                    runs[i] = _merged(runs[i] + [(r["first"], r["after"]) for r in old["runs"]])
                    items[i] |= set(old["items"])
            found = [{"n_words": n, "runs": [{"first": a, "after": b} for a, b in r], "items": sorted(s)} for n, r, s in zip(count, runs, items)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), pa.array(found, arrow)], [*names, name])

    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    used = sorted({*columns, at_text, *([] if at_leaks is None else [at_leaks])})
    place = {c: i for i, c in enumerate(used)}
    fields = [rows.schema.fields[i] for i in columns]
    columns, at_text, at_leaks = [place[c] for c in columns], place[at_text], None if at_leaks is None else place[at_leaks]
    return plain.select(*(F.col(f"c{i}") for i in used)).mapInArrow(of, T.StructType([*fields, T.StructField(name, kind)]))


def n_hit(leaks) -> F.Column:
    """Hit words of a column of `scanned`."""
    return F.aggregate(leaks["runs"], F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])


def cleaned(found: DataFrame, leaks: str = "leaks", most: float = 0.5) -> DataFrame:
    """What `scanned` gave without that column: hit spans are removed from the texts, and documents go of which a share of `most`
    or more is hit (0: all with hits)."""
    hit, own = n_hit(F.col(leaks)), F.col(leaks)

    @F.pandas_udf("string")
    def without(text, runs):
        return text.combine(runs, _without)

    kept = found.filter((hit == 0) | (hit < F.lit(most) * own["n_words"]))
    starts = F.transform(own["runs"], lambda r: F.array(r["first"], r["after"]))
    text = F.when(hit > 0, without("text", starts)).otherwise(F.col("text"))
    return kept.withColumn("text", text).drop(leaks)


def _without(text: str, runs: list) -> str:
    if text is None or not len(runs):
        return text
    words = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])
