"""The registered queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, filter_audit, framed_records, html_main_text, jpeg_media, lang_centroid, lm_backoff, multiset_hash, pack_histogram, pii_surrogates, pivotal_mix, simhash_ball, whitening
from quern.llm.common import stored


#: A test key.  Whoever holds a corpus passes a secret one.
SURROGATE_KEY = "quern-test-key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_backoff.scores(_documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 4))
    return found.select("doc_id", "n_words", "seen", F.round("score", 4).alias("score"), mean.alias("mean_score"))


OP1_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
t AS MATERIALIZED (
  SELECT r, i, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '<s> ') AS v FROM (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d)),
k AS (SELECT count(*) AS n, count(DISTINCT r) AS texts FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM t GROUP BY v, w),
d1 AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
d2 AS (SELECT r, v, w, count(*) AS n FROM t GROUP BY r, v, w),
x AS (
  SELECT t.r, c1.n - d1.n AS w1, c2.n - d2.n AS w2, CASE WHEN t.i = 1 THEN (SELECT texts FROM k) - 1 ELSE cv.n - dv.n END AS h2
  FROM t JOIN c1 USING (w) JOIN d1 USING (r, w) JOIN c2 USING (v, w) JOIN d2 USING (r, v, w)
  LEFT JOIN c1 cv ON t.v = cv.w LEFT JOIN d1 dv ON t.r = dv.r AND t.v = dv.w),
s AS (
  SELECT r, w2 > 0 AS hit,
         CASE WHEN w2 > 0 THEN ln(w2::DOUBLE) - ln(h2::DOUBLE)
              ELSE ln(0.4::DOUBLE) + (ln(greatest(w1, 1)::DOUBLE) - (SELECT ln(n::DOUBLE) FROM k)) END AS s
  FROM x)
SELECT d.doc_id, count(s.s) AS n_words, coalesce(sum(s.hit::INT), 0)::BIGINT AS seen, round(coalesce(sum(s.s), 0), 4) AS score,
       CASE WHEN count(s.s) > 0 THEN round(sum(s.s) / count(s.s), 4) END AS mean_score
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id
"""


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset_hash.compared(_documents(spark, sf_dir))
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        multiset_hash.to_hex(fp).alias("fingerprint"),
        multiset_hash.to_hex(edited).alias("edited_fingerprint"),
        multiset_hash.likeness(fp, edited).alias("near_edited"),
        multiset_hash.likeness(fp, after).alias("near_next"),
    )


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = lang_centroid.predicted(docs.select("doc_id", "text"), lang_centroid.fit(docs))
    return found.select(
        "doc_id",
        lang_centroid.held_out(F.col("doc_id")).alias("held_out"),
        F.col("lang_id.lang").alias("lang_pred"),
        F.col("lang_id.score").alias("score"),
        F.col("lang_id.accepted").alias("accepted"),
    )


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.round_trip(_documents(spark, sf_dir))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal_mix.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pack_histogram.pieces(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), "word", 1)
    cut = stored(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack_histogram.pack(cut, ["doc_id", "start", "ids_crc32"])


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii_surrogates.replaced(_documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)
    kinds = F.transform("pii_entities", lambda x: x.kind).alias("kinds")
    return made.select("doc_id", "text", F.size("pii_entities").alias("n_entities"), kinds)


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = framed_records.round_trip(spark, _documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), "byte", 0)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(vectors)
    return whitening.whitened(vectors, model).withColumn("identity_error", F.lit(whitening.identity_error(vectors, model)))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks, hit = F.col("leaks"), decontaminate.n_hit(F.col("leaks"))
    return decontaminate.scanned(docs, benchmark, keep=["doc_id"]).select(
        "doc_id",
        leaks["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(leaks["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leaks["items"], ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Windows as joined words; an item or document of no words has none.
OP12_SQL = """
WITH words AS (
  SELECT kind, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
        UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark)),
b AS (SELECT DISTINCT id::VARCHAR AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
d AS MATERIALIZED (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM b) WHERE kind = 'd' AND len(w) >= k)),
h AS MATERIALIZED (SELECT d.r, d.i, d.k, b.item FROM d JOIN b USING (k, win)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT words.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN it USING (r) WHERE kind = 'd'
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: All orders are applied one filter after the other to the documents of each mask; no polynomial here.
OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
least_id AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
         CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM t JOIN least_id USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
x AS (
  SELECT part, filter_order, step, filter_order[step:step] AS own, n, good, bad, fails, contains(fails, filter_order[step:step]) AS failing,
         length(fails) > 0 AND length(translate(fails, filter_order[1:step - 1], '')) < length(fails) AS before
  FROM s, c),
y AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT failing AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN failing AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN failing AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT before THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_stupid_backoff, op2_multiset_fingerprint, op3_html_main_text, op4_language_id, op5_jpeg_media, op6_pivotal_mixing, op7_spf_packing, op8_pii_surrogates, op9_simhash_neardup, op10_framed_records, op11_embedding_whitening, op12_benchmark_decontamination, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_stupid_backoff": OP1_SQL, "op12_benchmark_decontamination": OP12_SQL, "op13_filter_audit": OP13_SQL}
