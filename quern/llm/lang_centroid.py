"""Language identification by nearest centroid over normalised TF-IDF vectors of character n-grams.

A text is lower-cased, runs of other characters than letters become one space, and its n-grams of two and three
characters are hashed to DIMS bins.  A vector holds log(1 + count) * idf, scaled to length one.  Document
frequencies are counted over all training documents.  Each language's training vectors are clustered by spherical
k-means into CLUSTERS centroids.  That is fitted on a sample of about SAMPLE documents a language (those with the
smallest hash of doc_id and text; the share kept is SAMPLE / their number): one half of it makes the centroids, the
other sets the distance.  A text gets the language of the centroid with the largest cosine.  It is rejected if its cosine,
relative to what a text of its length should reach, is below that of all but REJECTED of the other half's texts to
their own languages.  Model.rates tells how many of those are rejected, and how many are accepted if their own language is
taken away (which tells how alike the languages are).

Defined results.  A null text or one without letters is `und` with score 0 and rejected; so is every text if no
training document has a language and a letter.  Equal cosines go to the first language in order.  Training ignores
rows with null lang or doc_id; repeated rows count as often as they stand there.  Very long texts are read whole, SPAN
characters at one time, with the n-grams across.  More than LANGUAGES labels raise ValueError.  If docs has a column
lang_id, the new one's name gets underscores until it is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import free_name, require, text_batches

DIMS = 1 << 14
CLUSTERS = 4
#: Training documents a language that clustering and rejection see, about.  The count of documents does not change it.
SAMPLE = 1000
#: Share of texts in a known language that may be rejected.
REJECTED = 0.002
#: Labels of the training documents at most: the driver holds centroids for each.
LANGUAGES = 1000
#: n-grams at which a text's cosine is expected to reach 1/sqrt(2) of its limit.
HALF_LENGTH = 400.0
#: Decimals of a cosine.
DECIMALS = 6
#: Characters handled at one time.
SPAN = 1 << 20

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _bins(text: str, tail: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a span's n-grams, with those that begin in the two codes (or fewer) before it, and the codes for the next."""
    code = np.frombuffer(text.replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code, np.uint32(32))
    code = np.concatenate((tail, code, [np.uint32(32)] if last else [])).astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), code
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    both = np.concatenate((two[len(tail) - 1 :], three))
    both ^= both >> np.uint32(15)
    return (both * np.uint32(0x2C1B3C6D) >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64), code[-2:]


def count_matrix(texts: list[str | None]) -> np.ndarray:
    """Counts of each text's n-grams by bin, over the whole of every text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    group: list[np.ndarray] = []
    for i, text in enumerate(texts):
        tail = np.array([32], np.uint32)
        for at in range(0, len(text or ""), SPAN):
            bins, tail = _bins(text[at : at + SPAN], tail, at + SPAN >= len(text))
            if len(text) > SPAN:
                out[i] += np.bincount(bins, minlength=DIMS)
            else:
                group.append(bins + i * DIMS)
    if group:
        out.reshape(-1)[:] += np.bincount(np.concatenate(group), minlength=len(texts) * DIMS)
    return out


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, out=counts)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.maximum(norm, 1e-12)[:, None]
    return v


def _expected(n: np.ndarray) -> np.ndarray:
    return np.sqrt(n / (n + HALF_LENGTH))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # each centroid's place in langs
    least: float = 0.0  # the smallest accepted cosine, relative to the expected one
    rates: tuple[float, float] = (0.0, 0.0)  # shares rejected of the sample's other half, and accepted without their own language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether each is accepted."""
        langs, scores, accepted = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            counts = count_matrix(part)
            n = counts.sum(axis=1, dtype=np.float64)
            if not len(self.centroids):
                langs += ["und"] * len(part)
                continue
            # sums in double precision and few decimals: a text's score does not depend on its batch
            cos = np.round(_unit(counts.astype(np.float64), self.idf) @ self.centroids.T.astype(np.float64), DECIMALS)
            best = cos.argmax(axis=1)
            top = np.clip(cos[np.arange(len(part)), best], 0, 1)
            own = self.owner[best]
            some = n > 0
            langs += [self.langs[o] if s else "und" for o, s in zip(own, some)]
            scores[at : at + 64] = np.where(some, top, 0.0)
            accepted[at : at + 64] = some & (top >= self.least * _expected(np.maximum(n, 1)))
        return langs, scores, accepted


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest vector and then those farthest from all chosen."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    centre = v[chosen].copy()
    for _ in range(rounds):
        own = (v @ centre.T).argmax(axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                mean = v[own == j].mean(axis=0)
                centre[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centre


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """A model of the documents with a language that are not held out."""
    rows = require(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(~held_out(F.col("doc_id")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS + 1, np.int64), 0
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 64):
                seen = count_matrix(texts.slice(at, 64).to_pylist()) > 0
                total[:-1] += seen.sum(axis=0)
                total[-1] += seen.any(axis=1).sum()
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(total[bins])], ["bin", "n"])

    with text_batches(docs.sparkSession):
        found = rows.select("text").mapInArrow(frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS + 1)
    df[found.bin.to_numpy(int)] = found.n.to_numpy(float)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n)))) if sizes else None
    if not sizes:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    picked = rows.filter(chance < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts = count_matrix(part.column("text").to_pylist())
                at_bin = [np.flatnonzero(c).astype(np.int32) for c in counts]
                n = [c[b] for c, b in zip(counts, at_bin)]
                arrays = [part.column("doc_id"), part.column("lang"), pa.array(at_bin, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "bins", "counts"])

    with text_batches(docs.sparkSession):
        got = picked.mapInArrow(vectors, "doc_id long, lang string, bins array<int>, counts array<float>").toPandas()
    got = got[got.bins.map(len) > 0].sort_values(["lang", "doc_id"], kind="stable")
    langs = sorted(got.lang.unique())
    if not langs:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int))
    def dense(part: pd.DataFrame) -> np.ndarray:
        counts = np.zeros((len(part), DIMS), np.float32)
        for row, bins, n in zip(counts, part.bins, part.counts):
            row[np.asarray(bins, int)] = n
        return counts

    own = [got[got.lang == lang] for lang in langs]
    centres = [_cluster(_unit(dense(x.iloc[::2]), idf), clusters) for x in own]
    centroids, of = np.concatenate(centres), np.repeat(np.arange(len(langs)), [len(c) for c in centres])
    mine, strange = [], []
    for i, x in enumerate(own):
        half = x.iloc[1::2] if len(x) > 1 else x  # a single document does for both
        for at in range(0, len(half), 64):
            counts = dense(half.iloc[at : at + 64])
            total = counts.sum(axis=1, dtype=np.float64)
            cos = (_unit(counts, idf) @ centroids.T) / _expected(total)[:, None]
            mine.append(cos[:, of == i].max(axis=1))
            if len(langs) > 1:
                strange.append(cos[:, of != i].max(axis=1))
    near = np.concatenate(mine)
    least = float(np.quantile(near, REJECTED))
    rates = float((near < least).mean()), float((np.concatenate(strange) >= least).mean()) if strange else 0.0
    return Model(langs, idf, centroids, of, least, rates)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column lang_id: struct(lang, score, accepted) of each whole text, whatever its other columns are."""
    name = free_name("lang_id", docs.columns)
    at_text = docs.columns.index("text")
    found = T.StructType().add("lang", "string").add("score", "double").add("accepted", "boolean")
    fields = [pa.field("lang", pa.string()), pa.field("score", pa.float64()), pa.field("accepted", pa.bool_())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lang, score, accepted = model.predict(part.column(at_text).to_pylist())
                own = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], fields=fields)
                yield pa.RecordBatch.from_arrays([*part.columns, own], [*names, name])

    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots can't be passed on
    return plain.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(name, found)]))
