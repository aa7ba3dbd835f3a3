import bisect

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import common as c


@pytest.mark.parametrize("tree", [512, 0])
@pytest.mark.parametrize("bounds", [[], [5], [-3, 0, 7], list(range(0, 3000, 3))])
def test_bucket_of(spark, monkeypatch, tree, bounds):
    monkeypatch.setattr(c, "TREE", tree)
    keys = [None, -(1 << 63), -4, -3, 0, 1, 5, 6, 7, 2997, 2998, (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", c.bucket_of(F.col("k"), bounds).alias("b"))
    assert [r["b"] for r in df.collect()] == [0 if k is None else bisect.bisect_right(bounds, k) for k in keys]


def test_cuts_are_values_of_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k"))
    found = c.cuts(df, "k", 10)
    assert len(found) == 9 and all(x % 7 == 0 for x in found) and found == sorted(found)
    assert c.cuts(df.filter("false"), "k", 10) == [] and c.cuts(df, "k", 1) == []


def test_stored_keeps_schema_and_setting(spark):
    before = spark.conf.get(c.CLEANUP, "false")
    df = c.stored(spark.range(5).selectExpr("id", "cast(null as string) as s"), "test")
    assert df.count() == 5 and df.columns == ["id", "s"] and spark.conf.get(c.CLEANUP, "false") == before


def test_texts_come_in_small_batches(spark):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(c.BATCH_ROWS)
    df = spark.range(0, 2500, 1, 1).mapInArrow(rows, "n long")
    assert [r["n"] for r in c.stored(df, "test", texts=True).collect()] == [1000, 1000, 500]
    assert [r["n"] for r in c.stored(df, "test").collect()] == [2500] and spark.conf.get(c.BATCH_ROWS) == before


def test_require_takes_exact_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert c.require(df, "a.b").first()[0] == 1
    with pytest.raises(ValueError):
        c.require(df, "x")
