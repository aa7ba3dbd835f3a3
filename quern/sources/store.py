"""Reading and writing of datasets, inventories, blobs and results."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The schemas of the datasets.
QUESTIONS = (
    "no int, family string, variant string, country string, language string, tax_category string, primary_taxpayer string, "
    "year_period_target string, case_year int, difficulty string, question string, final_answer_text string, answer_value string, "
    "unit string, gold_steps array<struct<step:string,result:string,unit:string,citations:array<string>>>, status string, note string"
)
CITATIONS = (
    "question_no int, language string, citation_id string, official_title string, law_number string, article_section string, "
    "paragraph string, subparagraph string, rule_applies_from string, rule_applies_until string, official_source_url string, "
    "source_file string, supporting_passage string"
)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document, an array of rows; rows that do not fit the schema are an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def unknown_keys(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(keys) of rows with keys that the schema does not have, which a reader would drop silently."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<string>")).alias("row"))
    extra = F.array_except(F.json_object_keys("row"), F.array(*map(F.lit, schema.fieldNames())))
    return rows.select(extra.alias("keys")).filter(F.size("keys") > 0)


def save_json(path: str, value: object) -> None:
    """A small document on the driver: written beside its place, flushed to disk and renamed."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_once(path: str, data: bytes) -> None:
    """Equal bytes may be there already; others are a conflict, and nothing is ever overwritten."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        try:
            os.link(name, path)
        except FileExistsError:
            with open(path, "rb") as f:
                if f.read() != data:
                    raise FileExistsError(f"SOURCE_FILE_CONFLICT: {path}") from None
    finally:
        os.unlink(name)


def safe_path(root: str, value: str) -> str:
    """A relative path below root; ValueError if it leaves it, also by a link."""
    if not value or PurePosixPath(value).is_absolute() or "\\" in value or "\0" in value:
        raise ValueError("not a relative path")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, value))
    if os.path.commonpath([base, full]) != base or full == base:
        raise ValueError("outside its folder")
    return full


def canonical_hash(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def row_hash(*columns: Column) -> Column:
    """SHA-256 of a row's JSON, for checkpoints keyed by their input."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def document_id(url: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(url, 256), 1, 20))


def inventory_issues(documents: DataFrame, blobs: DataFrame, allowed: Column) -> DataFrame:
    """(id, issue) of an inventory (id, url, sha256, text_sha256, boundaries, extraction_gaps, partial) against stored
    blobs (id, raw, text): identity, policy, both checksums, offsets in range, and partial if and only if there are gaps."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    rows = documents.withColumns({"n": n, "ok_url": allowed}).join(blobs.select("id", "raw", F.col("text").alias("body")), "id", "left")
    outside = F.exists("boundaries", lambda b: (b["start"] < 0) | (b["end"] < b["start"]) | (b["end"] > F.char_length("body")))
    rules = {
        "id twice": F.col("n") > 1,
        "id is not of url": F.col("id") != document_id(F.col("url")),
        "url not allowed": ~F.col("ok_url"),
        "no file": F.col("raw").isNull(),
        "raw checksum": F.sha2("raw", 256) != F.col("sha256"),
        "text checksum": F.sha2("body", 256) != F.col("text_sha256"),
        "offsets": outside,
        "partial flag": F.col("partial") != (F.size("extraction_gaps") > 0),
        "blank text": F.trim("body") == "",
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return rows.select("id", F.explode(broken).alias("issue")).distinct()


def verified_texts(spark: SparkSession, paths: list[str] | str, inventory: DataFrame) -> DataFrame:
    """(id, text, issue): stored text files (name is the id) whose checksum is the inventory's and that are UTF-8."""
    files = spark.read.format("binaryFile").load(paths)
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "content")
    rows = inventory.select("id", "text_sha256").join(rows, "id", "left")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    issue = F.when(F.col("content").isNull(), "no file").when(F.sha2("content", 256) != F.col("text_sha256"), "checksum").when(text.isNull(), "undecodable").when(F.trim(text) == "", "blank")
    return rows.select("id", F.when(issue.isNull(), text).alias("text"), issue.alias("issue"))


def corpus(inventory: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, title, text) of documents that are no navigation and have a text."""
    return inventory.filter("kind is null or kind <> 'navigation'").select("id", "title").join(texts.filter("issue is null").select("id", "text"), "id")


def with_citations(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """questions with an array of their citations in order of number; empty where they have none."""
    number = F.substring("citation_id", 2, 9).cast("int")
    own = F.array_sort(F.collect_list(F.struct(number.alias("n"), *(F.col(c) for c in citations.columns if c != "question_no"))))
    grouped = citations.groupBy(F.col("question_no").alias("no")).agg(own.alias("citations"))
    empty = F.array().cast(grouped.schema["citations"].dataType)
    return questions.join(grouped, "no", "left").withColumn("citations", F.coalesce("citations", empty))


def exported(questions: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated questions by number and their citations by (question, number of citation)."""
    q = questions.filter("status = 'validated'")
    c = citations.join(q.select(F.col("no").alias("question_no")), "question_no", "left_semi")
    return q.orderBy("no"), c.orderBy("question_no", F.substring("citation_id", 2, 9).cast("int"))


def write_results(records: DataFrame, folder: str) -> None:
    """Evaluation records, one folder a condition."""
    records.write.mode("overwrite").partitionBy("condition").json(folder)


def missing_only(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet: rows whose key no valid checkpoint (raw_response that is no recorded error) has."""
    valid = done.filter("raw_response is not null and not startswith(raw_response, '[EVALUATION ERROR')")
    return wanted.join(valid.select(key), key, "left_anti")


Responder = "Iterator[pandas.DataFrame] -> Iterator[pandas.DataFrame]"


def responded(rows: DataFrame, responder, schema: str, parallel: int = 8) -> DataFrame:
    """Rows sent through a pluggable responder (a model, an embedder, a fetcher) in batches, `parallel` at a time.

    Tasks may be run again after a failure, so a responder must be safe to call twice for a key.
    """
    return rows.repartition(parallel).mapInPandas(responder, schema)


def recorded(answers: dict[str, str]):
    """A responder for tests: answers by key, null where none was recorded."""

    def respond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(raw_response=rows["key"].map(answers))

    return respond
