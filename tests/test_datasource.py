import json

import pytest
from pyspark.sql import functions as F

from quern.sources import datasource as d

HOSTS = ("a.org", "b.org", "c.org")
POLICY = json.dumps({h: ["/.*"] for h in HOSTS})
URLS = [f"https://{h}/{i}" for h in HOSTS for i in range(1, 5)] + ["https://a.org/missing", "https://b.org/fault", "https://c.org/moved", "https://evil.org/1"]


@pytest.fixture
def source(spark):
    d.register(spark)
    return lambda **more: {"urls": "\n".join(URLS), "transport": "tests.pages_transport:get", "policy": POLICY, "retries": "0"} | more


def test_a_read_is_planned_by_host(spark, source):
    df = spark.read.format("quern_pages").options(**source(partitions="2")).load()
    got = {r["url"]: r for r in df.withColumn("part", F.spark_partition_id()).collect()}
    assert got.keys() == set(URLS)
    assert got["https://a.org/1"]["content"] == b"page https://a.org/1" and got["https://a.org/1"]["code"] is None
    assert got["https://c.org/moved"]["final_url"] == "https://c.org/1" and len(got["https://c.org/moved"]["redirects"]) == 2
    assert [got[f"https://{u}"]["code"] for u in ("a.org/missing", "b.org/fault", "evil.org/1")] == ["HTTP_STATUS", "TRANSPORT_KeyError", "URL_POLICY"]
    for h in HOSTS:
        assert len({r["part"] for u, r in got.items() if u.startswith(f"https://{h}/")}) == 1
    assert len({r["part"] for r in got.values()}) == 2


def test_budget_of_a_partition(spark, source):
    df = spark.read.format("quern_pages").options(**source(partitions="1", budget="45", urls="\n".join(URLS[:6]))).load()
    codes = [r["code"] for r in df.collect()]
    assert codes[:2] == [None, None] and codes[-1] == "PARTITION_LIMIT" and 0 < codes.count(None) < 6


def test_a_filter_on_urls_keeps_the_others_from_being_asked_for(spark, source):
    df = spark.read.format("quern_pages").options(**source()).load()
    one = df.filter((F.col("url") == URLS[2]) & F.col("code").isNull())
    assert [r["url"] for r in one.collect()] == [URLS[2]] and one.rdd.getNumPartitions() == 1
    assert df.filter(F.col("url").isin(URLS[0], URLS[4], "other")).count() == 2


def test_pushed_filters_leave_urls_out_of_the_plan():
    reader = d.PagesReader({"urls": "\n".join(URLS), "transport": "x:y"})
    rest = list(reader.pushFilters([d.In(("url",), tuple(URLS[:3])), d.EqualTo(("code",), "x"), d.EqualTo(("url",), URLS[1])]))
    assert len(rest) == 1 and reader.urls == [URLS[1]]
    assert [p.urls for p in reader.partitions()] == [[URLS[1]]]
    assert [len(p.urls) for p in d.planned([], 4)] == [0]


def test_a_stream_goes_on_where_it_ended(spark, source, tmp_path):
    def run(urls):
        q = spark.readStream.format("quern_pages").options(**source(urls="\n".join(urls), batch="3")).load().select("url", "code").writeStream.format("parquet")
        q = q.option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]

    assert sorted(run(URLS[:5])) == sorted(URLS[:5])
    assert sorted(run(URLS[:9])) == sorted(URLS[:9])  # each once


def test_bounds(monkeypatch):
    monkeypatch.setattr(d, "MOST", 2)
    with pytest.raises(ValueError):
        d.PagesReader({"urls": "\n".join(URLS), "transport": "x:y"})
