import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern import sql
from quern.operators import search

LONG = "word " * 150 + "the land here and " + "filler " * 150 + "tax " + "end " * 100
DOCS = [
    (1, "Intro line\nArticle 1. Land tax\nThe land tax is ten.\nThe tax\non land\nfollows.\n\nArticle 2. Other\r\nLAND and, once more, Tax\rlast"),
    (2, None), (3, ""), (4, "Article 5. Land\n" + LONG + "\nland\x0btax\u2028land tax\n"), (5, "no such thing\n" * 30),
    (6, "".join(f"Article {i}. The label of it\nbody of {i} with land\nand tax\n" for i in range(60))), (7, "landtax land_tax tax-land\nLand\n\n\ntax"),
]


@pytest.fixture
def docs(spark, rows):
    d = rows("id long, text string, title string", *((*d, "t") for d in DOCS))
    d.createOrReplaceTempView("laws")
    sql.register(spark)
    return d


def same(a, b):
    columns = b.columns
    assert sorted(a.columns) == sorted(columns)
    a, b = (sorted(map(tuple, x.select(*columns).collect()), key=repr) for x in (a, b))
    assert a == b
    return len(a)


@pytest.mark.parametrize("query", ["land tax", "tax", "lan*", "land", "the land", "10", "nothing", ""])
def test_find(spark, docs, query):
    same(spark.sql(f"SELECT * FROM find_in(TABLE(laws), '{query}')"), search.find(docs, query).drop("phrase", "patterns"))


@pytest.mark.parametrize("a,b", [(1, 3), (2, 2), (7, 9), (3, 2), (0, 5), (1, 401), (40, 50)])
def test_read_lines(spark, docs, a, b):
    want = search.read_lines(docs, docs.select(F.col("id").alias("span_id"), "id", F.lit(a).alias("start_line"), F.lit(b).alias("end_line"))).drop("span_id")
    assert same(spark.sql(f"SELECT * FROM read_lines_of(TABLE(laws), {a}, {b})"), want) == len(DOCS)


@pytest.mark.parametrize("query", ["", "land", "label 7", "other"])
def test_sections(spark, docs, query):
    same(spark.sql(f"SELECT * FROM sections_of(TABLE(laws), '{query}')"), search.list_sections(docs, query))


def test_best_hits_of_many_queries(spark, docs):
    found = None
    for i, query in enumerate(["land tax", "tax", "lan*"]):
        one = search.find(docs, query).withColumn("query_id", F.lit(i))
        found = one if found is None else found.unionByName(one)
    cost = F.char_length(F.to_json(F.struct("id", "line_no", "excerpt")))
    found.withColumn("cost", cost).createOrReplaceTempView("hits")
    got = spark.sql("SELECT * FROM best_hits_of(TABLE(hits), 6, 2000)")
    for i in range(3):
        own = found.filter(F.col("query_id") == i).drop("query_id")
        want = search.best_hits(own, 6, 2000)
        assert 0 < same(got.filter(F.col("query_id") == i).select(*want.columns), want) <= 6


def test_wrong_arguments_are_errors_of_the_query(spark, docs):
    for call in ("find_in(TABLE(laws), 'a*b')", "find_in(TABLE(laws), 3)", "find_in(TABLE(SELECT 1 AS x), 'a')", "read_lines_of(TABLE(laws), 'a', 2)", "best_hits_of(TABLE(laws), 1, 2)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}")
