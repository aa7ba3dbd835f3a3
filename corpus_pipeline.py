"""From raw documents to packed training sequences: five stages, each one operator of quern.llm.

language_id   documents whose language is rejected go; lang becomes the predicted one
near_dedup    one document (the smallest doc_id) of each group of exact and near copies stays: shingles of five
              words, similarity 0.8 or more, links followed through a group
pii           personal data and secrets in text become surrogates; n_chars follows
mixing        sources are mixed to their target weights: a document is repeated as often as it is taken, or dropped
packing       token ids are cut into pieces and packed into sequences of 2048

Every stage but the last returns the columns of documents.  Rows with equal doc_id are separate documents; near_dedup
keeps one row of each group: of its smallest doc_id the text with the smallest digest.  Nulls: a null text is
rejected by language_id; a null doc_id is no group's smallest unless all are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import lang_centroid, pack_histogram, pii_surrogates, pivotal_mix, simhash_ball
from quern.llm.common import require, small, stored
from quern.llm.queries import SURROGATE_KEY, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lang_centroid.predicted(require(docs, *COLUMNS), lang_centroid.fit(docs))
    return found.filter("lang_id.accepted").withColumn("lang", F.col("lang_id.lang")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash_ball.similar_documents(docs, words=5, similarity=0.8)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    kept = groups.groupBy("group").agg(first).select("group", F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    each = groups.groupBy("group", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).join(kept, "group")
    own = (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    # what goes, and of equal rows all but one; both are few, so that most texts need no shuffle
    other = stored(each.select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"), own.alias("own"), "n").filter("not own or n > 1"), "others")
    rows = require(docs, *COLUMNS).withColumn("digest", simhash_ball.text_digest())
    same = (F.col("digest") == F.col("other_digest")) & F.col("doc_id").eqNullSafe(F.col("other_id"))
    once = rows.join(small(other), same, "left_anti")
    repeated = rows.join(small(other.filter("own")), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return once.unionByName(repeated).select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pii_surrogates.replaced(require(docs, *COLUMNS), SURROGATE_KEY)
    return made.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.sha2(F.to_json(F.struct(*COLUMNS)), 256)  # equal rows are one here and share their copies
    rows = require(docs, *COLUMNS).withColumn("row", row)
    taken = pivotal_mix.mix(rows, carry=("row",))
    taken = stored(taken.groupBy("row").agg(F.sum("copies").alias("copies")).filter("copies > 0"), "taken")
    return rows.dropDuplicates(["row"]).join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = pack_histogram.pieces(docs, tokenizer("word_bpe_49k.json"), "word", 1, slots=pack_histogram.LESS_MEMO)
    cut = stored(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces", texts=True)
    return pack_histogram.pack(cut, ["doc_id", "start", "ids_crc32"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no counterpart to hashing by centroids, surrogates or dependent rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
