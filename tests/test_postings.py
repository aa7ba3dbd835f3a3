import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions.text import bag
from quern.operators import postings, retrieval
from quern.tables import spread

TEXTS = ["", "Income TAX of 2020, the tax", "a b 7 77", "Налоговый кодекс_1 Статья", "第三条 所得税 income", "longword longword longest", "xÉtudes études ١٢٣", None, "The the THE", "tax tax tax tax income"]


@pytest.fixture
def corpus(spark):
    rng = random.Random(3)
    words = ["tax", "income", "the", "levied", "percent", "budget", "налог", "земля"] + [f"word{i}" for i in range(60)]
    texts = TEXTS + [" ".join(rng.choice(words[: rng.choice([4, 8, 68])]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "income tax"), (2, "the the TAX word5"), (3, "nothing-known"), (4, ""), (5, "налог word1 word2 word3 the income"), (6, "the")], "query_id long, query string")


def test_counts_equal_the_bag_of_tokens(corpus):
    rows = corpus.select("text", bag(F.lower("text")).alias("t")).collect()
    for r in rows:
        assert postings.term_counts((r["text"] or "").lower()) == Counter(r["t"] or [])


def brute(corpus, queries, k):
    """Sums by the formula, over all passages and queries."""
    docs = {r["chunk_id"]: postings.term_counts((r["text"] or "").lower()) for r in corpus.collect()}
    n, average = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    out = {}
    for r in queries.collect():
        scores = []
        for i, d in docs.items():
            own = [t for t in postings.term_counts(r["query"].lower()) if t in d]
            if own:
                s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / average)) for t in own)
                scores.append((-round(s, 6), i))
        out[r["query_id"]] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: x for q, x in out.items() if x}


def ranked(best):
    out = {}
    for r in best.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


@pytest.mark.parametrize("asked", [postings.ASKED, 3])
def test_scores_against_brute_force(corpus, queries, monkeypatch, asked):
    monkeypatch.setattr(postings, "ASKED", asked)
    got = ranked(retrieval.top(retrieval.bm25(corpus, queries), 7))
    want = brute(corpus, queries, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


@pytest.mark.parametrize("k,block", [(1, 4096), (3, 4096), (5, 16), (40, 4096)])
def test_the_index_gives_the_best_passages_and_reads_less(corpus, queries, monkeypatch, k, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "FIRST", 3)
    best, read = retrieval.best_by_index(corpus, queries, k)
    assert ranked(best) == ranked(retrieval.top(retrieval.bm25(corpus, queries), k))
    counts = {r["query_id"]: (r["postings"], r["read"]) for r in read.collect()}
    assert counts.keys() == {1, 2, 5, 6} and all(0 < b <= a for a, b in counts.values())
    if k == 1:
        assert counts[5][1] < 0.5 * counts[5][0]


def test_blocks_are_bounded_and_hold_every_posting_once(corpus, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    posted = postings.counted(corpus)
    blocks, bands = postings.index(posted)
    rows = blocks.collect()
    assert sum(len(r["chunk_ids"]) for r in rows) == posted.filter("term <> ''").count() == bands.agg(F.sum("n")).first()[0]
    assert all(r["impacts"] == sorted(r["impacts"], reverse=True) and r["bound"] == r["impacts"][0] <= postings.K1 + 1 for r in rows)
    assert max(len(r["chunk_ids"]) for r in rows) < 40


def test_no_passages_or_queries(corpus, queries):
    assert retrieval.bm25(corpus.limit(0), queries).count() == 0
    assert retrieval.bm25(corpus, queries.limit(0)).count() == 0
    best, read = retrieval.best_by_index(corpus.limit(0), queries, 3)
    assert best.count() == read.count() == 0


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
