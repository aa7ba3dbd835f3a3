import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import pivotal_mix as m


def test_targets_share_by_weight_and_stop_at_three_times():
    assert m.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 300 * 5 / 8, "b": 75.0, "c": 37.5}
    t = m.targets([(None, 10), ("b", 1000), ("a", 10)])
    assert t["a"] == 30.0 and sum(t.values()) == pytest.approx(1020) and t[None] <= 30
    assert m.targets([]) == {} and m.targets([("a", 0)]) == {"a": 0.0}


def test_sums_come_near_their_targets(documents):
    got = m.mix(documents, group=8).toPandas()
    got["taken"] = got.copies * got["size"]
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
        assert (g.copies <= 3).all() and (g.copies >= 0).all()


def test_reruns_and_partitioning_agree(spark, documents):
    key = ["doc_id", "copies"]
    a = m.mix(documents, group=8).select(key).orderBy("doc_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        b = m.mix(documents.repartition(5), group=8).select(key).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert a == b


def plain_pivot(rows):
    """One group, (chance, size, p) in order, by the definition: pairs exchange mass until one of the two is integral."""
    settled, held = [None] * len(rows), None
    for i, (chance, size, p) in enumerate(rows):
        if size == 0 or p <= 0 or p >= 1:
            settled[i] = p
        elif held is None:
            held = (i, size, p)
        else:
            j, other, q = held
            up, down = min(size * p, other * (1 - q)), min(size * (1 - p), other * q)
            give = chance < down / (up + down)  # so that the expected move is 0
            p, q = (p - up / size, q + up / other) if give else (p + down / size, q - down / other)
            pair = {i: (size, p), j: (other, q)}
            near = lambda x: abs(x - round(x)) < 1e-9
            held = None
            for k, (n, x) in pair.items():
                if near(x):
                    settled[k] = float(round(x))
                else:
                    held = (k, n, x)
    if held:
        settled[held[0]] = held[2]
    return settled


def frame(groups):
    rows = [(0, g, i, "s", size, 1, 0.0, 0.0, 1, 0, p, c) for g, own in enumerate(groups) for i, (c, size, p) in enumerate(own)]
    return pd.DataFrame(rows, columns=["source_no", "grp", "doc_id", "source", "size", "source_size", "target", "rate", "groups", "whole", "p", "chance"])


def test_pairing_equals_brute_force():
    rng = random.Random(6)
    groups = [[(rng.random(), rng.choice([0, 1, 2, 5, 30]), rng.choice([0.0, 1.0, rng.random(), rng.random(), rng.random()])) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    whole = frame(groups)
    for cut in (len(whole), 37):  # in one batch or in several
        out = pd.concat(m._pivot(whole.iloc[a : a + cut] for a in range(0, len(whole), cut)))
        got = {(r.grp, r.doc_id): r.p for r in out.itertuples()}
        assert len(out) == len(whole)
        for g, own in enumerate(groups):
            assert [got[g, i] for i in range(len(own))] == pytest.approx(plain_pivot(own), abs=1e-9)


def test_expectation_is_kept():
    rng, rounds = random.Random(8), 4000
    own = [(rng.choice([1, 2, 7]), rng.uniform(0.1, 0.9)) for _ in range(9)]
    whole = frame([[(rng.random(), size, p) for size, p in own] for _ in range(rounds)])
    out = pd.concat(m._pivot(iter([whole])))
    mean = out.groupby("doc_id").p.mean()
    for i, (_, p) in enumerate(own):
        assert abs(mean[i] - p) < 4 * math.sqrt(0.25 / rounds)
    kept = out.assign(mass=out.p * out["size"]).groupby("grp").mass.sum()
    assert kept.to_numpy() == pytest.approx(sum(size * p for size, p in own))


def test_one_doc_id_spreads_over_groups(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = m.mix(docs.union(docs.limit(5)), group=16, carry=("text",))
    assert got.columns[-1] == "text" and got.count() == 2005
    sums = got.agg(F.sum(F.col("copies") * F.col("size")), F.first("target")).first()
    assert abs(sums[0] - sums[1]) <= 3


def test_too_many_sources(rows, monkeypatch):
    monkeypatch.setattr(m, "SOURCES", 1)
    with pytest.raises(ValueError):
        m.mix(rows("doc_id long, text string, source string", (1, "a", "x"), (2, "b", "y")))


def test_odd_rows(odd, no_docs):
    got = m.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert m.mix(no_docs).count() == 0
    sizes = {r["doc_id"]: r["size"] for r in got if r["doc_id"] is not None}
    assert sizes[1] == 6 and sizes[2] == 0 and sizes[9] == 0


def test_hot_source_goes_through_several_levels(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    got = m.mix(docs, group=16).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r["k"] - r["t"]) <= 3 for r in got)


def nearest(sizes, copies, target):
    """Whether no single copy more or less brings the sum nearer."""
    rest = target - sum(s * c for s, c in zip(sizes, copies))
    able = [s for s, c in zip(sizes, copies) if s and (c < 3 if rest > 0 else c > 0)]
    return not able or abs(rest) <= min(able)


def test_a_source_with_one_huge_document_meets_its_target(spark):
    docs = [(i, "w " * n, s) for s, own in (("a", [5000, *[30] * 40, 7, 3]), ("b", [4000, 900, 60, 50, 40, 2]), ("c", [10] * 50)) for i, n in enumerate(own)]
    got = m.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), group=8).toPandas()
    for _, g in got.groupby("source"):
        assert nearest(g["size"], g.copies, g.target.iloc[0])
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 10


def test_each_source_is_as_near_as_single_copies_make_it(documents):
    got = m.mix(documents).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert nearest(g["size"], g.copies, g.target.iloc[0])


def test_filling_by_single_copies():
    pool = lambda rest, own: pd.DataFrame([(i, s, c, 0.5, rest) for i, (s, c) in enumerate(own)], columns=["doc_id", "size", "copies", "draw", "rest"])
    assert m._filled(pool(25.0, [(20, 2), (10, 0), (4, 3), (1, 1)]), 3).set_index("doc_id").copies.to_dict() == {0: 3, 1: 0, 2: 3, 3: 3}
    assert m._filled(pool(-9.0, [(20, 2), (8, 1), (4, 0), (2, 1)]), 3).set_index("doc_id").copies.to_dict() == {0: 2, 1: 0, 2: 0, 3: 1}
    assert m._filled(pool(-9.4, [(8, 1), (2, 1)]), 3).set_index("doc_id").copies.to_dict() == {0: 0, 1: 0}
