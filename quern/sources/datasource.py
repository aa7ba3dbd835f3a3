"""Remote pages as a source of Spark: `spark.read.format("quern_pages")` and `readStream`, over a transport of `sources.remote`.

    register(spark)
    spark.read.format("quern_pages").options(urls="https://a.org/1\\nhttps://a.org/2", transport="my.module:get", policy='{"a.org": [".*"]}').load()

Options: urls (one a line, MOST at most: they are part of the plan), transport (module:function, importable on the executors), policy (JSON: path
patterns by host), partitions, budget (bytes that one partition may read; what is left over gets PARTITION_LIMIT), interval (seconds between two
requests of a partition), most (bytes of a page), retries, redirects, batch (urls of one micro-batch).

Partitions are planned by host, so that the interval holds for each host; filters on url (=, in) that Spark pushes down leave urls out of the plan.
A stream's offset is its place in the list: a restarted one goes on there.  Failures are values in the column code.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from quern.sources.remote import Refused, fetch

SCHEMA = "url string, content binary, final_url string, redirects array<string>, code string"
#: Urls of one read.
MOST = 100_000
Row = tuple[str, bytes | None, str | None, list[str] | None, str | None]


class Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


def _listed(options: dict[str, str]) -> list[str]:
    urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").split("\n") if u.strip()))
    if len(urls) > MOST:
        raise ValueError(f"more than {MOST} urls; use sources.remote.fetched on a table of them")
    return urls


def _host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def planned(urls: list[str], n: int) -> list[Urls]:
    """At most n partitions; a host is in one only, the host with most urls goes first to the partition with fewest."""
    by_host: dict[str, list[str]] = {}
    for url in urls:
        by_host.setdefault(_host(url), []).append(url)
    parts: list[list[str]] = [[] for _ in range(max(1, min(n, len(by_host))))]
    for _, own in sorted(by_host.items(), key=lambda x: (-len(x[1]), x[0])):
        min(parts, key=len).extend(own)
    return [Urls(p) for p in parts]


def read_pages(urls: list[str], options: dict[str, str]) -> Iterator[Row]:
    """Pages one after the other, within the budget and at the interval."""
    module, _, name = options["transport"].partition(":")
    get, policy = getattr(importlib.import_module(module), name), json.loads(options.get("policy", "{}"))
    limits = {k: int(options[k]) for k in ("most", "retries", "redirects") if k in options}
    left, interval = int(options.get("budget", 1 << 40)), float(options.get("interval", 0))
    for i, url in enumerate(urls):
        if left <= 0:
            yield url, None, None, None, "PARTITION_LIMIT"
            continue
        if i and interval:
            time.sleep(interval)
        try:
            content, final, way = fetch(url, get, policy, **limits)
            left -= len(content)
            yield url, content, final, way, None
        except Refused as e:
            yield url, None, None, None, str(e)
        except Exception as e:  # a transport's own fault concerns its row only
            yield url, None, None, None, f"TRANSPORT_{type(e).__name__}"


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.urls = options, _listed(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u == f.value]
            elif isinstance(f, In) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u in set(f.value)]
            else:
                yield f

    def partitions(self) -> list[Urls]:
        return planned(self.urls, int(self.options.get("partitions", 8)))

    def read(self, partition: Urls) -> Iterator[Row]:
        return read_pages(partition.urls, self.options)


class PagesStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.urls, self.batch = options, _listed(options), int(options.get("batch", 100))

    def initialOffset(self) -> dict[str, int]:
        return {"at": 0}

    def read(self, start: dict[str, int]) -> tuple[Iterator[Row], dict[str, int]]:
        end = {"at": min(len(self.urls), start["at"] + self.batch)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[Row]:
        return iter(list(read_pages(self.urls[start["at"] : end["at"]], self.options)))


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict[str, Any]:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema: Any) -> PagesReader:
        return PagesReader(self._plain())

    def simpleStreamReader(self, schema: Any) -> PagesStream:
        return PagesStream(self._plain())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
