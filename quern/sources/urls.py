"""Which urls may be fetched, and links found on pages."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PRIORITY = 50


def allowed(url: Column, policy: dict[str, list[str]], exact: list[str] = ()) -> Column:
    """https, a listed host, no user, port 443 or none, no fragment, and a path that one of the host's patterns matches whole.

    The path is matched as it is written; decoded it must not hold dot segments, and never an encoded slash,
    backslash, NUL or percent sign.  A query is only allowed in a url that is listed exactly.
    """
    parts = r"^https://([A-Za-z0-9.-]+)(:[0-9]+)?(/[^?#]*)?(\?[^#]*)?$"
    name, port = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    path, query = F.regexp_extract(url, parts, 3), F.regexp_extract(url, parts, 4)
    path = F.when(path == "", "/").otherwise(path)
    clean = ~url.rlike(r"[\\\x00-\x20\x7f]") & ~path.rlike(r"(?i)%(?:2f|5c|00|25)")
    decoded = F.regexp_replace(path, r"(?i)%2e", ".")
    clean = clean & ~decoded.rlike(r"(?:^|/)\.{1,2}(?:/|$)")
    fits = F.lit(False)
    for h, patterns in policy.items():
        for p in patterns:
            fits = fits | ((name == h.lower()) & path.rlike(f"^(?:{p})$"))
    listed = url.isin(*exact) if exact else F.lit(False)
    ok = url.rlike(parts) & port.isin("", ":443") & clean & (listed | (fits & (query == "")))
    return F.coalesce(ok, F.lit(False))


def rule_priority(url: Column, rules: list[tuple[str, int]]) -> Column:
    """The lowest priority of the rules (pattern of the whole url, priority) that match; null if none does."""
    found = [F.when(url.rlike(f"^(?:{p})$"), F.lit(n)) for p, n in rules]
    return F.least(*found, F.lit(None).cast("int")) if found else F.lit(None).cast("int")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, link_text) of the links of pages (page_id, url, html), joined to the page's url, fragments gone.

    The first of equal urls of a page stays.
    """
    pattern = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))[^>]*>(.*?)</a>"
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(found).alias("pos", "a"))
    href = F.coalesce(*(F.nullif(F.regexp_extract("a", pattern, i), F.lit("")) for i in (1, 2, 3)))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", pattern, 4), r"<[^>]*>", ""), r"\s+", " "))
    rows = rows.select("page_id", "base", "pos", href.alias("href"), text.alias("link_text")).filter("href is not null")

    @F.pandas_udf("string")
    def join(base, href):
        import pandas as pd

        def one(b, h):
            try:
                return urldefrag(urljoin(b or "", h)).url
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)

    rows = rows.withColumn("url", join("base", "href")).filter("url is not null and url <> ''")
    n = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    return rows.withColumn("n", n).filter("n = 1").select("page_id", "pos", "url", "link_text")


def capped_links(found: DataFrame, rules: list[tuple[str, int]], most: int) -> tuple[DataFrame, DataFrame]:
    """Links that a rule takes, by (priority, url), at most `most` a page; and (page_id, code, remaining) for the rest."""
    ranked = found.withColumn("priority", rule_priority(F.col("url"), rules)).filter("priority is not null")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("priority", "url"))
    ranked = ranked.withColumn("n", n)
    rest = ranked.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return ranked.filter(F.col("n") <= most).drop("n"), rest.select("page_id", F.lit("LINK_LIMIT").alias("code"), (F.col("n") - most).alias("remaining"))


def added_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Policy entries (key, value) of old that new lacks; an extension of a policy has none."""
    return old.join(new, ["key", "value"], "left_anti")
