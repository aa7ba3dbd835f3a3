import math
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import lang_centroid as c


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = c.predicted(docs, c.fit(docs)).filter(c.held_out(F.col("doc_id"))).select((F.col("lang") == F.col("lang_id.lang")).cast("int").alias("ok"), F.col("lang_id.accepted").cast("int").alias("a")).agg(F.avg("ok"), F.avg("a")).first()
    assert got[0] >= 0.98 and got[1] >= 0.98


def test_held_out_rows_do_not_train(documents):
    changed = documents.withColumn("lang", F.when(c.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in c.fit(changed).langs


def test_odd_rows(odd, documents):
    model = c.fit(documents)
    got = c.predicted(odd, model).select("doc_id", "text", "lang_id").collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(x.isalpha() for x in r["text"] or "")
        assert (r["lang_id"]["lang"] == "und") == (not letters)
        assert 0 <= r["lang_id"]["score"] <= 1 and (letters or not r["lang_id"]["accepted"])


def test_foreign_script_is_rejected(documents):
    lang, score, accepted = c.fit(documents).predict(["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "x" * 500])
    assert not accepted[0] and not accepted[1]


def test_no_training_data(no_docs, odd):
    model = c.fit(no_docs)
    assert model.langs == [] and c.predicted(no_docs, model).count() == 0
    assert {r["lang_id"]["lang"] for r in c.predicted(odd, model).collect()} == {"und"}


def test_spans_change_nothing(monkeypatch, documents):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["ab", "a", "", None, "  x  ", "ΑΣ ΑΣΑ " * 9]
    whole = c.count_matrix(texts)
    for span in (7, 64):
        monkeypatch.setattr(c, "SPAN", span)
        assert (c.count_matrix(texts) == whole).all()


def plain_bins(text):
    """n-grams of two and three characters by plain slicing, hashed with 32-bit arithmetic."""
    letters = "".join(x if x.isalpha() else " " for x in text.replace("Σ", "σ").lower())
    letters = f" {' '.join(letters.split())} " if letters.split() else " "
    out = Counter()
    for n in (2, 3):
        for i in range(len(letters) - n + 1):
            x, y = ord(letters[i]), ord(letters[i + 1])
            h = (x * 0x9E3779B1 + y * 0x85EBCA77) % 2**32
            if n == 3:
                h = (h * 0xC2B2AE3D + ord(letters[i + 2]) * 0x27D4EB2F + 0x165667B1) % 2**32
            h ^= h >> 15
            out[(h * 0x2C1B3C6D % 2**32) >> (32 - 14)] += 1
    return out


def test_predictions_equal_brute_force(documents):
    model = c.fit(documents)
    texts = [r["text"] for r in documents.limit(40).collect()] + ["one", "Der Hund", "zzz"]
    lang, score, accepted = model.predict(texts)
    for text, l, s, a in zip(texts, lang, score, accepted):
        v = {b: math.log1p(n) * float(model.idf[b]) for b, n in plain_bins(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(row[b]) for b, x in v.items()) / norm for row in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        n = sum(plain_bins(text).values())
        assert l == model.langs[model.owner[best]] and s == pytest.approx(cos[best], abs=1e-4)
        assert a == (s >= model.least * math.sqrt(n / (n + 400)))


def test_rejection_rejects_and_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = c.fit(docs), random.Random(4)
    assert 0 < model.least < 1 and 0 < model.rates[0] <= 0.01
    junk = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 10))) for _ in range(n)) for n in (5, 50, 500) for _ in range(60)]
    assert not any(model.predict(junk)[2])
    got = c.predicted(docs, model).filter(c.held_out(F.col("doc_id")) & (F.length("text") > 200)).agg(F.avg(F.col("lang_id.accepted").cast("int"))).first()
    assert got[0] >= 0.99


def test_names_and_labels(odd, no_docs, monkeypatch):
    model = c.fit(no_docs)
    assert c.predicted(odd.withColumn("Lang_Id", F.lit(1)), model).columns[-1] == "lang_id_"
    monkeypatch.setattr(c, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        c.fit(odd)


def test_repeated_rows_get_equal_answers(documents):
    few = documents.orderBy("doc_id").limit(20)
    got = c.predicted(few.union(few), c.fit(documents)).groupBy("doc_id", "text", "lang_id").count().collect()
    assert all(r["count"] == 2 for r in got)


def test_a_score_does_not_depend_on_the_batch(documents):
    model = c.fit(documents)
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(100).collect()]
    together = model.predict(texts)
    for i, text in enumerate(texts):
        lang, score, accepted = model.predict([text])
        assert (lang[0], score[0], accepted[0]) == (together[0][i], together[1][i], together[2][i])
