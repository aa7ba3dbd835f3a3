"""Remote sources behind pluggable transports: pages by http, model responses and embeddings.

A transport is a picklable function that does one exchange; policies, redirects, retries, limits, batches and caches are
here.  They run per batch of rows through mapInPandas, so that a table of urls or prompts is a distributed source.
Failures are values (a code), never exceptions of a task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes that mean a redirect, and those that may pass.
REDIRECTS = frozenset([301, 302, 303, 307, 308])
PASSING = frozenset([408, 429, 500, 502, 503, 504])
BATCH, LONGEST = 100, 3000


@dataclass
class Response:
    """One exchange: status, headers with lower-case names, and the body in pieces."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: Iterable[bytes] = ()


class Refused(Exception):
    """A failure with its code."""


def permits(url: str, policy: dict[str, list[str]]) -> bool:
    """Whether https, host and path are allowed: the policy has path patterns by host."""
    m = re.fullmatch(r"https://([a-z0-9.-]+)(?::443)?(/[^#]*)", url)
    if m is None or re.search(r"(?i)%2f|%5c|%00|%25|/\.{1,2}(/|$|\?)", m[2]):
        return False
    return any(re.fullmatch(p, m[2]) for p in policy.get(m[1], ()))


def fetch(url: str, get: Callable[[str], Response], policy: dict[str, list[str]], redirects: int = 5, retries: int = 2, most: int = 50 << 20, wait: Callable[[float], None] = time.sleep) -> tuple[bytes, str, list[str]]:
    """(body, final url, urls on the way); Refused with a code otherwise.  Every url is checked before it is asked for."""
    way: list[str] = []
    for _ in range(redirects + 1):
        if not permits(url, policy):
            raise Refused("URL_POLICY")
        way.append(url)
        answer, body = _tried(lambda: _read(get(url), most), retries, wait)
        if answer.status in REDIRECTS:
            if not answer.headers.get("location"):
                raise Refused("REDIRECT_INVALID")
            url = urljoin(url, answer.headers["location"])
            continue
        if answer.status != 200:
            raise Refused("HTTP_STATUS")
        return body, url, way
    raise Refused("REDIRECT_LIMIT")


def _read(answer: Response, most: int) -> tuple[Response, bytes]:
    return answer, _limited(answer, most) if answer.status == 200 else b""


def _tried(exchange: Callable[[], tuple[Response, bytes]], retries: int, wait: Callable[[float], None]) -> tuple[Response, bytes]:
    """An exchange with its whole body: an answer that breaks off is asked for again, as is a passing status."""
    for attempt in range(retries + 1):
        try:
            done, code = exchange(), None
        except TimeoutError:
            done, code = None, "CONNECT_TIMEOUT"
        except OSError:
            done, code = None, "CONNECT_ERROR"
        if done is not None and (done[0].status not in PASSING or attempt == retries):
            return done
        if attempt == retries:
            raise Refused(code)
        wait(min(0.25 * 2**attempt, 2.0))
    raise Refused("CONNECT_ERROR")


def _limited(answer: Response, most: int) -> bytes:
    declared = answer.headers.get("content-length", "")
    if declared.isdigit() and int(declared) > most:
        raise Refused("DOWNLOAD_LIMIT")
    parts, size = [], 0
    for part in answer.body:
        size += len(part)
        if size > most:
            raise Refused("DOWNLOAD_LIMIT")
        parts.append(part)
    return b"".join(parts)


def fetched(urls: DataFrame, get: Callable[[str], Response], policy: dict[str, list[str]], **limits: int) -> DataFrame:
    """(url, content, final_url, redirects, code) for a column url; code is null for success."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for url in rows["url"]:
                try:
                    out.append((url, *fetch(url, get, policy, **limits), None))
                except Refused as e:
                    out.append((url, None, None, None, str(e)))
                except Exception as e:  # a transport's own fault concerns its row only
                    out.append((url, None, None, None, f"TRANSPORT_{type(e).__name__}"))
            yield pd.DataFrame(out, columns=["url", "content", "final_url", "redirects", "code"])

    return urls.select("url").mapInPandas(run, "url string, content binary, final_url string, redirects array<string>, code string")


def asked(prompt: str, model: Callable[[str], str], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> str:
    """A model's response: passing errors are tried again after 3, 6, 12, ... seconds (60 at most), blank ones after two."""
    for attempt in range(tries):
        last = attempt == tries - 1
        try:
            said = model(prompt)
        except (OSError, TimeoutError):
            if last:
                raise
            wait(min(60.0, 3.0 * 2 ** min(attempt, 4)))
            continue
        if said.strip() or last:
            return said
        wait(2.0)
    return ""


def responder(model: Callable[[str], str], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A responder for plans.evaluation.responses; what fails for good becomes an '[EVALUATION ERROR' response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for prompt in rows["prompt"]:
                try:
                    out.append(asked(prompt, model, tries, wait))
                except Exception as e:
                    out.append(f"[EVALUATION ERROR: {type(e).__name__}]")
            yield rows.assign(raw_response=out)[["key", "prompt", "raw_response"]]

    return run


def embedded(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding, code) of texts (key, text), code null for success: those of the cache, and of keys without one in batches of BATCH texts cut at LONGEST characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), BATCH):
                part = rows.iloc[at : at + BATCH]
                try:
                    found = embed([t[:LONGEST] for t in part["text"]])
                    if len(found) != len(part):
                        raise ValueError("another number of vectors than texts")
                    yield pd.DataFrame({"key": part["key"], "embedding": found, "code": None})
                except Exception as e:
                    yield pd.DataFrame({"key": part["key"], "embedding": None, "code": f"EMBEDDING_{type(e).__name__}"})

    missing = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    known = cache.join(texts.select("key").distinct(), "key", "left_semi").select("key", "embedding", F.lit(None).cast("string").alias("code"))
    return known.unionByName(missing.mapInPandas(run, "key string, embedding array<double>, code string"))
