"""Ranking of passages for queries: BM25, time-aware BM25, dense re-ranking, reciprocal rank fusion, and hit metrics.

All queries are ranked in one plan.  A corpus is (chunk_id, source_id, title, text), queries are (query_id, query)
and optionally case_year.  Equal scores are ordered by chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.temporal import multiplier
from quern.functions.text import bag, normal, source_id
from quern.operators.postings import best, counted, idf, impact, index, scored, stats
from quern.tables import few, stored

TITLE_YEAR_BOOST = 1.25
POOL, RRF_K = 30, 60
# Phrases of passages that state a year's amounts.
PARAMETER_KEYWORDS = (
    "месячный расчетный показатель", "минимальный размер заработной платы", "айлық есептік көрсеткіш",
    "жалақының ең төменгі мөлшері", "first schedule", "rates of income-tax",
)


def bm25(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): sums over a query's distinct terms, to six decimals."""
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(bag(F.col("query")))).alias("term")), "asked")
    sums = scored(corpus, asked)
    if sums is not None:
        return sums.withColumn("score", F.round("score", 6))
    posted = counted(corpus, asked)  # too many queries to send to the tasks
    found = posted.filter("term <> ''")
    weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats(posted)))
    terms = asked.join(weights.select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avg_length"), "term")
    terms = few(stored(terms, "asked-weights"))
    part = F.col("idf") * impact(F.col("tf"), F.col("length"), F.col("avg_length"))
    return found.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def best_by_index(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best passages of BM25 through an index of postings by impact, and how many postings each query read of its own."""
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(bag(F.col("query")))).alias("term")), "asked")
    return best(*index(counted(corpus, asked)), asked, k)


def boosted(scores: DataFrame, corpus: DataFrame, queries: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Scores times the title-year boost and, with metadata (id, y_eff, y_snap, is_code, is_budget), the time weight."""
    out = scores.join(corpus.select("chunk_id", "source_id", "title"), "chunk_id").join(queries.select("query_id", "case_year"), "query_id")
    factor = F.when(F.col("title").contains(F.col("case_year").cast("string")), TITLE_YEAR_BOOST).otherwise(1.0)
    if metadata is not None:
        codes = metadata.filter("is_code and y_eff is not null").agg(F.array_sort(F.collect_set("y_eff")).alias("code_years"))
        out = out.join(metadata.withColumnRenamed("id", "source_id").drop("title").withColumn("known", F.lit(True)), "source_id", "left").crossJoin(F.broadcast(codes))
        weight = multiplier(*map(F.col, ("y_eff", "y_snap", "is_code", "is_budget", "case_year", "code_years")))
        factor = factor * F.when(F.col("known"), weight).otherwise(1.0)
    return out.select("query_id", "chunk_id", F.round(F.col("score") * factor, 6).alias("score"))


def top(scores: DataFrame, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best of each query with ranks from 1; groups are cut in each task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def parameter_passages(corpus: DataFrame, metadata: DataFrame) -> DataFrame:
    """(case_year, chunk_id, source_id): the first passage for each year that states its amounts."""
    text = F.lower("text")
    states = F.exists(F.array(*map(F.lit, PARAMETER_KEYWORDS)), lambda p: F.contains(text, p))
    spans = metadata.filter("y_eff is not null").select(F.col("id").alias("source_id"), F.explode(F.sequence("y_eff", F.greatest(F.col("y_snap") + 1, F.col("y_eff")))).alias("case_year"))
    first = F.min(F.struct("chunk_id", "source_id"))
    return corpus.filter(states).join(spans, "source_id").groupBy("case_year").agg(first.alias("p")).select("case_year", "p.chunk_id", "p.source_id")


def injected(ranked: DataFrame, queries: DataFrame, parameters: DataFrame, k: int) -> DataFrame:
    """Ranked passages with the year's parameter passage at rank 2, score 999, where it is not there and k is 3 or more."""
    if k < 3:
        return ranked
    extra = queries.select("query_id", "case_year").join(parameters, "case_year").select("query_id", "chunk_id")
    extra = extra.join(ranked, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(999.0).alias("score"), F.lit(2).alias("rank"))
    has = extra.select("query_id", F.lit(1).alias("shift"))
    moved = ranked.join(has, "query_id", "left").withColumn("rank", F.when((F.col("shift") == 1) & (F.col("rank") >= 2), F.col("rank") + 1).otherwise(F.col("rank")))
    return moved.select("query_id", "chunk_id", "score", "rank").unionByName(extra).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def reranked(pool: DataFrame, chunk_vectors: DataFrame, query_vectors: DataFrame, mode: str, k: int) -> DataFrame:
    """Dense or fused order of each query's pool (query_id, chunk_id, rank of BM25).

    dense: by cosine to four decimals; hybrid: by 1/(60 + BM25 rank) + 1/(60 + dense rank) to six.  Ties keep BM25 order.
    """
    rows = pool.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    rows = rows.join(chunk_vectors.select("chunk_id", F.col("vector").alias("cv")), "chunk_id", "left").join(query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id", "left")
    rows = rows.withColumn("cosine", cosine(F.col("cv"), F.col("qv"))).drop("cv", "qv")
    by_cosine = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "bm25_rank")
    rows = rows.withColumn("dense_rank", F.row_number().over(by_cosine))
    fused = F.round(1 / (RRF_K + F.col("bm25_rank")) + 1 / (RRF_K + F.col("dense_rank")), 6)
    rows = rows.withColumn("score", fused if mode == "hybrid" else F.round("cosine", 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "bm25_rank")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieved(corpus: DataFrame, queries: DataFrame, chunk_vectors: DataFrame, query_vectors: DataFrame, mode: str, k: int, metadata: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of one mode: bm25, dense or hybrid.

    The pool is BM25's best (time-aware with metadata), POOL of them at least; dense and hybrid order it by vectors.  With
    metadata the year's parameter passage is put at rank 2.
    """
    pool = top(boosted(bm25(corpus, queries), corpus, queries, metadata), max(POOL, k))
    best = pool.filter(F.col("rank") <= k) if mode == "bm25" else reranked(pool, chunk_vectors, query_vectors, mode, k)
    best = best.select("query_id", "chunk_id", "score", "rank")
    return best if metadata is None else injected(best, queries, parameter_passages(corpus, metadata), k)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(ids, values): up to `size` vectors a row as bytes, scaled to length one."""
    import numpy as np
    import pandas as pd

    def pack(batches):
        for rows in batches:
            for at in range(0, len(rows), size):
                part = rows.iloc[at : at + size]
                part = part[part["embedding"].map(lambda v: v is not None)]
                if len(part):
                    v = np.array(part["embedding"].tolist(), np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "values": [v.tobytes()]})

    return vectors.select("vec_id", "embedding").mapInPandas(pack, "ids binary, values binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors (vec_id, embedding) of largest cosine, to six decimals, for each query.

    Exact: every block of queries meets every block of vectors, and each meeting keeps k rows a query.
    """
    import numpy as np
    import pandas as pd

    q = _blocks(queries, 512).withColumnsRenamed({"ids": "q_ids", "values": "q_values"})

    def best(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                ids, asked = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                v, m = (np.frombuffer(x).reshape(n, -1) for x, n in ((r.values, len(ids)), (r.q_values, len(asked))))
                s = np.round(v @ m.T, 6)
                for j, i in enumerate(asked):
                    order = np.lexsort((ids, -s[:, j]))[:k]
                    yield pd.DataFrame({"query_id": i, "vec_id": ids[order], "score": s[order, j]})

    met = _blocks(vectors, block).crossJoin(q).mapInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hits(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, passage_recall, complete, source_recall, reciprocal_rank) for queries with gold passages.

    retrieved: query_id, rank, source_id, text; gold: query_id, source_file, passage.  A passage is found where a
    passage's text holds its first 60 characters, or its first 35 in its own source; an empty one never is.
    """
    g = gold.select("query_id", F.monotonically_increasing_id().alias("g"), source_id(F.coalesce("source_file", F.lit(""))).alias("gold_source"), normal(F.coalesce("passage", F.lit(""))).alias("p"))
    # a passage that several queries found is normalised once
    r = stored(retrieved.select("query_id", "rank", "source_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256)), "hits-found")
    texts = stored(r.groupBy("digest").agg(F.any_value("text").alias("text")).select("digest", normal(F.col("text")).alias("t")), "hits-texts")
    r = r.drop("text").join(texts, "digest").drop("digest")
    found = (F.col("p") != "") & (F.col("t").contains(F.substring("p", 1, 60)) | ((F.col("source_id") == F.col("gold_source")) & F.col("t").contains(F.substring("p", 1, 35))))
    each = g.join(r, "query_id", "left").groupBy("query_id", "g").agg(
        F.min(F.when(found, F.col("rank"))).alias("first"), F.first("gold_source").alias("gold_source"),
        F.coalesce(F.bool_or(F.col("source_id") == F.col("gold_source")), F.lit(False)).alias("source_hit"),
    )
    sources = F.collect_set(F.when(F.col("gold_source") != "", F.col("gold_source")))
    hit_sources = F.collect_set(F.when(F.col("source_hit") & (F.col("gold_source") != ""), F.col("gold_source")))
    out = each.groupBy("query_id").agg(F.count("first").alias("n_hit"), F.count(F.lit(1)).alias("n_gold"), F.min("first").alias("first"), F.size(sources).alias("n_sources"), F.size(hit_sources).alias("n_source_hit"))
    return out.select(
        "query_id",
        (F.col("n_hit") / F.col("n_gold")).alias("passage_recall"),
        (F.col("n_hit") == F.col("n_gold")).cast("int").alias("complete"),
        F.when(F.col("n_sources") > 0, F.col("n_source_hit") / F.col("n_sources")).otherwise(1.0).alias("source_recall"),
        F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0).alias("reciprocal_rank"),
    )
