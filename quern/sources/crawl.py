"""A crawl to its fixed point that can be stopped and resumed: what is known of each url is a log of committed batches.

The log has a row for each url that was found and for each that was fetched or failed.  A batch takes the open urls (found
but neither fetched nor failed: an anti-join of the log with itself) of the least depth, fetches and links them as one plan, and commits
all it learned at once.  A crawl that is killed goes on from its last commit; a complete one fetches nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.commits import CommitLog
from quern.sources.urls import allowed, capped_links, links
from quern.tables import scratch, stored

LOG = "url string, state string, depth int, priority int, observed_from string, html string, code string, remaining long"


def _rows(df: DataFrame, state: str, **given: str) -> DataFrame:
    """Rows of the log: columns of df, others by expression, else null."""
    kinds = dict(c.split() for c in LOG.split(", "))
    own = {"state": f"'{state}'"} | given
    return df.select(*(F.expr(own[c] if c in own else c if c in df.columns else "null").cast(k).alias(c) for c, k in kinds.items()))


def inventory(log: CommitLog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, failures, open urls) as they stand after the last commit."""
    rows = log.read()
    documents = rows.filter("state = 'fetched'").select("url", "depth", "priority", "observed_from", "html")
    failures = rows.filter("state in ('failed', 'limit')").select("url", "code", "remaining")
    return documents, failures, _open(rows)


def _open(rows: DataFrame) -> DataFrame:
    """A url counts by its first finding: the least depth, then priority, then the page it was found on."""
    found = rows.filter("state = 'found'").groupBy("url").agg(F.min(F.struct("depth", "priority", "observed_from")).alias("x")).select("url", "x.*")
    return found.join(rows.filter("state in ('fetched', 'failed')").select("url"), "url", "left_anti")


def resumed(
    spark: SparkSession, folder: str, start: DataFrame, fetch: Callable[[DataFrame], DataFrame], policy: dict[str, list[str]], rules: list[tuple[str, int]],
    max_documents: int = 1000, max_depth: int = 5, max_links: int = 200, max_pages: int | None = None, batch: int = 1000,
) -> CommitLog:
    """Start a crawl in a folder, or go on with the one that it holds; the log when nothing is left.

    fetch maps (url) to (url, html, code), code null for success.  Urls go by (depth, priority, url).  Limits leave a row with what
    remains: DOCUMENT_LIMIT on urls asked for, PAGE_LIMIT on pages whose links are followed, DEPTH_LIMIT, and LINK_LIMIT on a page.
    """
    log = CommitLog(spark, folder, LOG)
    if not log.commits():
        log.append(_rows(start.select("url").distinct(), "found", depth="0", priority="0"))
    while not log.complete():
        rows = log.read()
        ok = allowed(F.col("url"), policy)
        left = _open(rows)
        counts = rows.agg(F.count_if(F.col("state") == "fetched").alias("pages"), F.count_if((F.col("state") == "failed") & (F.col("code") != "URL_POLICY")).alias("failed")).first()
        here = left.agg(F.min("depth")).first()[0]
        if here is None or here > max_depth:
            if here is not None:
                log.append(_rows(left.agg(F.count(F.lit(1)).alias("remaining")), "limit", code="'DEPTH_LIMIT'"))
            log.finish()
            break
        wave = left.filter(F.col("depth") == here)
        refused = wave.filter(~ok)
        room = max_documents - counts["pages"] - counts["failed"]
        if room <= 0:
            rest = wave.filter(ok).agg(F.count(F.lit(1)).alias("remaining")).filter("remaining > 0")
            log.append(_rows(rest, "limit", code="'DOCUMENT_LIMIT'").unionByName(_rows(refused, "failed", code="'URL_POLICY'")))
            log.finish()
            break
        chosen = stored(wave.filter(ok).orderBy("priority", "url").limit(min(batch, room)), "wave")
        got = stored(chosen.join(fetch(chosen.select("url")), "url"), "fetched")  # once, whatever reads it
        pages = got.filter("code is null")
        follow = pages if max_pages is None else pages.orderBy("priority", "url").limit(max(0, max_pages - counts["pages"]))
        found, over = capped_links(links(follow.select(F.col("url").alias("page_id"), "url", "html")), rules, max_links)
        found = found.groupBy("url").agg(F.min(F.struct("priority", F.col("page_id").alias("observed_from"))).alias("x")).select("url", "x.*")
        new = found.join(rows.filter("state = 'found'").select("url"), "url", "left_anti")
        learned = [
            _rows(refused, "failed", code="'URL_POLICY'"),
            _rows(pages, "fetched"),
            _rows(got.filter("code is not null"), "failed"),
            _rows(new, "found", depth=str(here + 1)),
            _rows(over.withColumn("url", F.col("page_id")), "limit"),
        ]
        if max_pages is not None:
            cut = pages.agg((F.count(F.lit(1)) + counts["pages"] - max_pages).alias("remaining")).filter("remaining > 0")
            learned.append(_rows(cut, "limit", code="'PAGE_LIMIT'"))
        every = learned[0]
        for more in learned[1:]:
            every = every.unionByName(more)
        log.append(every)
    return log


def crawl(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], policy: dict[str, list[str]], rules: list[tuple[str, int]], folder: str | None = None, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of a whole crawl; with a folder it can be stopped and called again."""
    spark = start.sparkSession
    return inventory(resumed(spark, folder or scratch(spark, "crawl"), start, fetch, policy, rules, **limits))[:2]


def depths(found: DataFrame, root: str, most: int = 64) -> DataFrame:
    """(url, depth) by walking observed_from up to the root; urls that do not reach it are left out."""
    found.createOrReplaceTempView("quern_found")
    return found.sparkSession.sql(
        f"""WITH RECURSIVE walk(url, depth) MAX RECURSION LEVEL {most} AS (
              SELECT url, 0 FROM quern_found WHERE url = :root
              UNION ALL SELECT f.url, w.depth + 1 FROM quern_found f JOIN walk w ON f.observed_from = w.url)
            SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
        args={"root": root},
    )
