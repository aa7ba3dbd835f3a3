"""A country's settings: one JSON document, read and checked on the driver before anything runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

HOST = re.compile(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+")


def issues(config: dict) -> list[str]:
    """What is wrong with settings; nothing for good ones."""
    out = [f"{k}: a text is needed" for k in ("country", "language", "currency") if not isinstance(config.get(k), str) or not config[k].strip()]
    generation, sources = config.get("generation") or {}, config.get("sources") or {}
    periods, categories = generation.get("periods") or [], generation.get("categories") or []
    labels, codes = [p.get("label") for p in periods], [c.get("code") for c in categories]
    out += [f"{name} twice: {x}" for name, xs in (("period", labels), ("category", codes)) for x in sorted({x for x in xs if xs.count(x) > 1})]
    spans = sorted((p.get("start", 0), p.get("end", 0), p.get("label")) for p in periods)
    out += [f"period {label}: ends before it starts" for start, end, label in spans if end < start]
    out += [f"periods overlap: {a[2]}, {b[2]}" for a, b in zip(spans, spans[1:]) if b[0] <= a[1]]
    on = [c for c in categories if c.get("enabled", True)]
    out += [] if on else ["no category is enabled"]
    out += [f"category {c.get('code')}: a reason is needed" for c in categories if not c.get("enabled", True) and not c.get("reason")]
    out += [f"weight of {x.get('label') or x.get('code')}: over 0 is needed" for x in [*periods, *on] if not isinstance(x.get("weight"), (int, float)) or x["weight"] <= 0]
    for host, patterns in (sources.get("hosts") or {}).items():
        if not HOST.fullmatch(host):
            out.append(f"host {host}: a plain lower-case name is needed")
        for p in patterns:
            try:
                re.compile(p)
            except re.error:
                out.append(f"host {host}: {p} is no pattern")
            if not p.startswith("/"):
                out.append(f"host {host}: {p} must begin with a slash")
    limits = sources.get("limits") or {}
    out += [f"limit {k}: a whole number over 0 is needed" for k, v in limits.items() if type(v) is not int or v <= 0]
    return out


def load(path: str) -> dict:
    """Checked settings; ValueError with all that is wrong."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    found = issues(config)
    if found:
        raise ValueError("; ".join(found))
    return config


def policy_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(key, value): the source policy as rows, for comparing it with an earlier one (urls.added_only)."""
    hosts = (config.get("sources") or {}).get("hosts") or {}
    return spark.createDataFrame([(h, p) for h, ps in hosts.items() for p in ps], "key string, value string")


def periods(spark: SparkSession, config: dict) -> DataFrame:
    """(label, start, end, weight, pos) in order of the settings."""
    rows = [(p["label"], p["start"], p["end"], float(p["weight"]), i) for i, p in enumerate(config["generation"]["periods"])]
    return spark.createDataFrame(rows, "label string, start int, end int, weight double, pos int")
