import corpus_pipeline as c
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import queries as q
from quern.llm.common import stored


def test_stages_on_the_driver_tables(spark, tables, documents):
    docs, counts = documents, [documents.count()]
    for name, stage in c.STAGES[:-1]:
        docs = stored(stage(spark, docs, tables), f"test-{name}")
        assert docs.columns == c.COLUMNS
        counts.append(docs.count())
        if name == "near_dedup":
            kept = docs.select("text").collect()
            assert len({r["text"] for r in kept}) == len(kept)
    assert counts[1] >= 0.97 * counts[0] and counts[3] == counts[2] <= counts[1]
    packed = c.STAGES[-1][1](spark, docs, tables)
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert used.filter("n <> m or n > 2048").count() == 0
    assert packed.filter("start = 0").count() == counts[4]


def test_run_agrees_with_itself(spark, tables):
    a, b = (sorted(map(str, c.run(spark, tables).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert a == b


def test_odd_documents_and_no_documents(spark, tables, odd, no_docs):
    for docs in (odd, no_docs):
        for name, stage in c.STAGES:
            docs = stored(stage(spark, docs, tables), f"odd-{name}")
    assert docs.count() == 0


def test_packing_sends_texts_in_small_batches(spark, monkeypatch):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [1], "start": [0], "length": [batch.num_rows], "doc_tokens": [1], "ids": [b""]})

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"
    monkeypatch.setattr(c.pack_histogram, "pieces", lambda docs, *a, **b: docs.mapInArrow(rows, schema))
    assert sorted(r["length"] for r in c.packing(spark, spark.range(0, 2500, 1, 1), "").collect()) == [500, 1000, 1000]


def test_every_operator_is_registered():
    names = q.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(q.oracle_sql()) <= set(names)
