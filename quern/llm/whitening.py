"""Whitening of embeddings by a compensated covariance.

Entries c become integers x = floor(64 c) + 1,000,000, so that the sums S of n vectors are exact.  Each task centres its
vectors by S / n as double-double numbers and adds their outer products to a double-double matrix by error-free
transformations (two-sum, two-product).  Tasks emit one row a dimension with high and low parts, which are merged in two levels of
groups, never as plain sums.  The driver holds that d x d matrix only.  It is solved by LAPACK's reduction to a tridiagonal
matrix with divide and conquer (`numpy.linalg.eigh`); then eigenvalues and vectors are refined by the residuals
of the double-double matrix, so that components far smaller than the largest keep their digits.

Defined results.  A vector that is null or holds null, NaN or an infinity is left out everywhere.  Shorter vectors (an empty one too) are
filled up with entries 0 to the longest length; over LONGEST entries raise ValueError.  64 c is taken as at most 2**62 in
size.  Repeated rows and null vec_ids count as often as they stand there.  A component whose variance is under NOTHING of
the whole has null for whitened (as all do for one vector, or for equal ones); equal variances take any basis, the same for all
rows.  A deviation over the range of a long is null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import require

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of a vector at most: the driver holds the square of it.
LONGEST = 4096
#: Share of the whole variance under which a component counts as none.
NOTHING = 1e-20
#: Groups of tasks that are merged before all are.
GROUPS = 64
_BIG = 2.0**62


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, an array of longs, of every vector that is whole."""
    rows = require(vectors, "vec_id", "embedding")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), c.cast("double") * SCALE))) + SHIFT)
    return rows.filter(F.col("embedding").isNotNull() & ~bad).select("vec_id", x.alias("x"))


def _matrix(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of x, filled up to dims (or the longest)."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(sizes.max(initial=0)) if dims is None else dims
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Double-double arithmetic on arrays: a value is high + low, the low part under half a unit of the high one.


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_sum(a, b):
    s = a + b
    return s, b - (s - a)


def halves(a):
    c = a * 134217729.0  # 2**27 + 1
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def add(h, l, h2, l2):
    s, e = two_sum(h, h2)
    t, f = two_sum(l, l2)
    s, e = quick_sum(s, e + t)
    return quick_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over the first axis, pair by pair."""
    while len(high) > 1:
        half, odd = len(high) // 2, len(high) % 2
        h, l = add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = (np.concatenate((h, high[-1:])), np.concatenate((l, low[-1:]))) if odd else (h, l)
    return high[0], low[0]


def _parts(high: np.ndarray, low: np.ndarray, bits: int, axis: int) -> list[np.ndarray]:
    """Matrices of so few bits that products of two are exact; their sum is high + low."""
    out = []
    for rest in (high, low):
        rest = rest.copy()
        while rest.any() and len(out) < 12:
            top = np.abs(rest).max(axis=axis, keepdims=True)
            sigma = np.where(top > 0, 0.75 * 2.0 ** (np.ceil(np.log2(np.where(top > 0, top, 1))) + 53 - bits), 0)
            part = (rest + sigma) - sigma
            out.append(part)
            rest = rest - part
    return out


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The matrix product of two double-double matrices, from exact products of their parts."""
    bits = int((52 - np.ceil(np.log2(max(2, a[0].shape[1])))) // 2)
    high = low = np.zeros((a[0].shape[0], b[0].shape[1]))
    for x in _parts(*a, bits, 1):
        for y in _parts(*b, bits, 0):
            high, low = add(high, low, x @ y, np.zeros_like(high))
    return high, low


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns) of a symmetric double-double matrix.

    Each round takes the matrix to the present basis.  Values too close to be told apart by what is left beside the diagonal
    are solved anew as a block of their own, whose size then bounds the error; all others are corrected to first order, which
    squares the error (Ogita and Aishima).
    """
    _, x = np.linalg.eigh(high)
    x = x, np.zeros_like(x)

    def turned() -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        own = x[0].T.copy(), x[1].T.copy()
        h, l = product(own, x)
        gap = (np.eye(len(high)) - h) - l  # from an orthogonal basis
        h, l = product(own, product((high, low), x))
        value = (h.diagonal() + l.diagonal()) / (1 - gap.diagonal())
        off = h + l
        np.fill_diagonal(off, 0)
        return value, gap, off, 2 * (np.linalg.norm(off, 2) + np.abs(value).max() * np.linalg.norm(gap, 2))

    for _ in range(20):
        value, gap, off, near = turned()
        order = np.argsort(value)
        rotation = np.zeros_like(off)
        for own in np.split(order, np.flatnonzero(np.diff(value[order]) > near) + 1):
            _, rotation[np.ix_(own, own)] = np.linalg.eigh((off + np.diag(value))[np.ix_(own, own)])
        x = product(x, (rotation, np.zeros_like(rotation)))
        value, gap, off, near = turned()
        apart = value[None, :] - value[:, None]
        close = np.abs(apart) <= near
        turn = np.where(close, gap / 2, (off + value[None, :] * gap) / np.where(close, 1, apart))
        x = add(*x, x[0] @ turn, np.zeros_like(turn))
        scale = np.sqrt(np.abs(value))
        if np.abs(gap).max() < 1e-15 and (np.abs(off) <= 1e-12 * scale[:, None] * scale + NOTHING * np.abs(value).max()).all():
            break
    order = np.argsort(-value, kind="stable")
    return value[order], x[0][:, order]


@dataclass
class Whitening:
    n: int
    sums: list[int]  # exact, by dimension
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n as double-double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        share = [Fraction(s % self.n, self.n) for s in self.sums]
        high = np.array([float(f) for f in share])
        low = np.array([float(f - Fraction(float(f))) for f in share])
        a = x - whole
        ah = a.astype(np.float64)
        s, e = two_sum(ah, -high)
        return quick_sum(s, e + ((a - ah.astype(np.int64)).astype(np.float64) - low))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; None over the range of a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        a = x - whole
        if (int(np.abs(a).max(initial=0)) + 1) ** 2 * self.n**2 * max(1, x.shape[1]) < 1 << 62:
            y = a * self.n - rest
            return np.einsum("ij,ij->i", y, y).tolist()
        found = ((a.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened components (NaN where there is no variance); a row's are the same in whatever batch it comes."""
        k = min(components, len(self.values))
        some = self.values[:k] > max(NOTHING * self.trace, 0)
        axis = np.where(some, self.vectors[:, :k], np.nan)
        high, low = self.centred(x)
        out = np.zeros((len(x), k))
        for d in range(x.shape[1]):
            out += high[:, d, None] * axis[d] + low[:, d, None] * axis[d]
        return out / np.sqrt(np.where(some, self.values[:k], 1))


def _covariance(rows: DataFrame, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    d = len(model.sums)
    lanes = max(1, min(8, (1 << 14) // (d * d)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.zeros((lanes, d, d))
        low = np.zeros_like(high)
        for batch in _slices(batches, 4096 // d * lanes + lanes):
            h, l = model.centred(_matrix(batch.column(0), d))
            room = -len(h) % lanes  # rows of nothing fill the last lanes
            h, l = (np.concatenate((v, np.zeros((room, d)))).reshape(-1, lanes, d) for v in (h, l))
            for a, b in zip(h, l):
                p, e = two_product(a[:, :, None], a[:, None, :])
                e = e + (a[:, :, None] * b[:, None, :] + b[:, :, None] * a[:, None, :])
                high, low = add(high, low, p, e)
        h, l = total(high, low)
        part = pa.array(np.full(d, TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([part, pa.array(np.arange(d, dtype=np.int32)), pa.array(list(h)), pa.array(list(l))], ["part", "i", "high", "low"])

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        h, l = total(np.stack(own.high.to_list()), np.stack(own.low.to_list()))
        return pd.DataFrame({"part": own.part.iloc[:1] % GROUPS, "i": own.i.iloc[:1], "high": [h], "low": [l]})

    schema = "part int, i int, high array<double>, low array<double>"
    some = rows.select("x").mapInArrow(products, schema).groupBy("i", F.col("part") % GROUPS).applyInPandas(merged, schema)
    got = some.groupBy("i").applyInPandas(merged, schema).toPandas().sort_values("i")
    high, low = np.stack(got.high.to_list()), np.stack(got.low.to_list())
    q = high / model.n  # divided by n
    p, e = two_product(q, np.full_like(q, float(model.n)))
    return quick_sum(q, ((high - p) - e + low) / model.n)


def fit(vectors: DataFrame) -> Whitening:
    """Sums, covariance and its components, over all whole vectors."""
    rows = integers(vectors)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros((2, 0), np.int64)
        for batch in _slices(batches, 4096):
            x = _matrix(batch.column(0))
            n += len(x)
            own = np.stack(((x - SHIFT >> 32).sum(axis=0), (x - SHIFT & 0xFFFFFFFF).sum(axis=0)))
            grown = np.zeros((2, max(found.shape[1], own.shape[1])), np.int64)
            grown[:, : found.shape[1]] += found
            grown[:, : own.shape[1]] += own
            found = grown
        i = np.arange(-1, found.shape[1], dtype=np.int32)  # -1: the number of vectors
        yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(np.concatenate(([n], v))) for v in found)], ["i", "high", "low"])

    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if longest > LONGEST:
        raise ValueError(f"vectors of more than {LONGEST} entries")
    got = rows.select("x").mapInArrow(sums, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    n = got[0]["high"] if got else 0
    own = [(r["high"] << 32) + r["low"] + SHIFT * n for r in got[1:]]
    model = Whitening(n, own, np.zeros(0), np.zeros((len(own), 0)), 0.0)
    if n and own:
        high, low = _covariance(rows, model)
        model.trace = float(sum(Fraction(float(v)) for v in (*high.diagonal(), *low.diagonal())))
        model.values, model.vectors = eigen(high, low)
    return model


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """The largest entry, in size, of the covariance of what `whitened` gives minus the identity: moments of each task about
    its own means, merged by the distance of the means."""
    some = int((model.values[:components] > max(NOTHING * model.trace, 0)).sum())
    if not some:
        return 0.0

    def merge(a: tuple, b: tuple) -> tuple:
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in _slices(batches, 2048):
            w = model.project(_matrix(batch.column(0), len(model.sums)), some)
            mean = w.mean(axis=0)
            own = len(w), mean, (w - mean).T @ (w - mean)
            found = merge(found, own) if found else own
        if found:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found[0]], pa.int64()), pa.array([found[1]]), pa.array([found[2].ravel()])], ["part", "n", "mean", "m2"])

    def folded(own: pd.DataFrame) -> tuple:
        found = None
        for r in own.sort_values("part").itertuples():
            each = r.n, np.asarray(r.mean), np.asarray(r.m2).reshape(some, some)
            found = merge(found, each) if found else each
        return found

    def group(own: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = folded(own)
        return pd.DataFrame({"part": own.part.iloc[:1] % GROUPS, "n": [n], "mean": [mean], "m2": [m2.ravel()]})

    schema = "part int, n long, mean array<double>, m2 array<double>"
    got = integers(vectors).select("x").mapInArrow(moments, schema).groupBy(F.col("part") % GROUPS).applyInPandas(group, schema).toPandas()
    n, _, m2 = folded(got)  # GROUPS rows at most
    return float(np.abs(m2 / n - np.eye(some)).max())


def whitened(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained."""
    k, d = min(components, len(model.values)), len(model.sums)
    rows = integers(vectors)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained"]
    kind = dict(rows.dtypes)["vec_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1 + 32768 // max(1, k)):
            x = _matrix(batch.column(1), d)
            place = np.repeat(np.arange(len(x)), k)
            w = model.project(x, k).ravel()
            share = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)
            arrays = [
                batch.column(0).take(pa.array(place)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(place), model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(place)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(share, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(of, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")
