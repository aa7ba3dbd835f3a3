import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, x int, part string, n long, `a.b` int"


def vectors(spark, values, first=0):
    return spark.createDataFrame([(first + i, v, 1, "p", 2, 3) for i, v in enumerate(values)], SCHEMA)


def exact(values):
    """x, sums, covariance as fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in values]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[Fraction(n * r[j] - s[j], n) for j in range(d)] for r in x]
    return x, s, [[sum(r[i] * r[j] for r in y) / n for j in range(d)] for i in range(d)], y


def check(spark, values, k=w.COMPONENTS):
    df = vectors(spark, values).repartition(3)
    model = w.fit(df)
    x, s, v, y = exact(values)
    n, d = len(x), len(s)
    assert (model.n, model.sums) == (n, s)
    trace = sum(v[i][i] for i in range(d))
    assert abs(Fraction(model.trace) - trace) <= trace * Fraction(1, 10**14)
    for c in range(min(k, d)):  # each is an eigenvector to many digits of its own eigenvalue
        u = [Fraction(float(a)) for a in model.vectors[:, c]]
        vu = [sum(a * b for a, b in zip(r, u)) for r in v]
        e = Fraction(float(model.values[c]))
        assert abs(sum(a * a for a in u) - 1) < Fraction(1, 10**14)
        assert abs(sum(a * b for a, b in zip(u, vu)) - e) <= e * Fraction(1, 10**6)
    got = w.whitened(df, model, k).collect()
    assert len(got) == n * min(k, d)
    for r in got:
        own = y[r["vec_id"]]
        want = sum(a * Fraction(float(b)) for a, b in zip(own, model.vectors[:, r["component"] - 1]))
        want = float(want) / math.sqrt(model.values[r["component"] - 1])
        assert r["whitened"] == pytest.approx(want, rel=1e-7, abs=1e-7)
        deviation = sum((n * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (deviation if deviation < 1 << 63 else None)
        assert r["n"] == n
    for c in range(1, min(k, d) + 1):
        assert Fraction(next(r["explained"] for r in got if r["component"] == c)) == pytest.approx(float(model.values[c - 1]) / float(trace), rel=1e-9)
    assert w.identity_error(df, model, k) < 1e-6
    table = np.zeros((n, min(k, d)))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs((table - table.mean(0)).T @ (table - table.mean(0)) / n - np.eye(min(k, d))).max() < 1e-6
    return model


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(60, 8)).tolist())
    check(spark, (rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))).tolist(), k=3)


def test_small_components_beside_huge_ones(spark):
    rng = np.random.default_rng(2)
    scaled = rng.normal(size=(50, 6)) * [1e7, 1e5, 1e3, 10, 1, 0.2]
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    model = check(spark, (scaled @ turn).tolist())
    assert model.values[0] / model.values[-1] > 1e12


def test_an_outlier_does_not_spoil_the_rest(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(50, 5)).tolist()
    values[7] = [1e8, -1e8, 3e8, 1.0, 1e8]
    check(spark, values)


def test_equal_variances(spark):
    check(spark, [[float(s) if i == j else 0.0 for j in range(4)] for i in range(4) for s in (1, -1)])


def test_left_out_and_filled_up(spark):
    nan, inf = float("nan"), float("inf")
    df = vectors(spark, [[1.0, 2.0, 3.0], None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, -inf], [], [0.5], [4.0, 1.0, 2.0], [4.0, 1.0, 2.0], [-3.0, 2.5, 7.0]])
    df = df.union(df.filter("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")))
    model = w.fit(df)
    assert (model.n, len(model.sums)) == (7, 3)
    got = w.whitened(df, model)
    assert {r["vec_id"] for r in got.select("vec_id").distinct().collect()} == {0, 5, 6, 7, 8, 9, None}
    a, b = (got.filter(F.col("vec_id") == i).orderBy("component").select("whitened", "deviation").collect() for i in (7, 8))
    assert a == b and len(a) == 3
    assert w.identity_error(df, model) < 1e-9


def test_no_variance(spark):
    for values in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        df = vectors(spark, values)
        model = w.fit(df)
        assert all(r["whitened"] is None and r["deviation"] == 0 for r in w.whitened(df, model).collect())
        assert w.identity_error(df, model) == 0.0
    flat = vectors(spark, [[float(i), 2.0] for i in range(4)])
    got = w.whitened(flat, w.fit(flat)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got)


def test_empty_table_and_bounds(spark, monkeypatch):
    none = vectors(spark, [])
    assert w.whitened(none, w.fit(none)).count() == 0
    assert w.identity_error(none, w.fit(none)) == 0.0
    huge = vectors(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]])
    assert all(r["deviation"] is None for r in w.whitened(huge, w.fit(huge)).filter("vec_id < 2").collect())
    monkeypatch.setattr(w, "LONGEST", 1)
    with pytest.raises(ValueError):
        w.fit(huge)


def test_sums_of_double_doubles_keep_small_parts():
    h, l = w.total(np.array([[1e16], [1.0], [-1e16], [1e-8]]), np.zeros((4, 1)))
    assert h[0] + l[0] == 1.0 + 1e-8
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 5, 7)) * 10.0 ** rng.integers(-9, 9, size=(5, 1)), rng.normal(size=(2, 7, 3))
    a[1], b[1] = a[1] * 1e-18, b[1] * 1e-18
    h, l = w.product((a[0], a[1]), (b[0], b[1]))
    for i in range(5):
        for j in range(3):
            want = sum((Fraction(a[0, i, k]) + Fraction(a[1, i, k])) * (Fraction(b[0, k, j]) + Fraction(b[1, k, j])) for k in range(7))
            assert abs(Fraction(h[i, j]) + Fraction(l[i, j]) - want) < Fraction(1, 10**26) * Fraction(float(np.abs(a[0, i]).max())) * 10


def test_a_row_is_the_same_in_any_batch(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    model = w.fit(df)
    a = w.whitened(df, model).filter("vec_id < 50").orderBy("vec_id", "component").collect()
    b = w.whitened(df.filter("vec_id < 50").repartition(7), model).orderBy("vec_id", "component").collect()
    assert a == b
