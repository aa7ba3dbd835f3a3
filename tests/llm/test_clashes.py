"""Columns whose names differ from an operator's own in case only."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quern.llm import framed_records, html_main_text, jpeg_media, lang_centroid, lm_backoff, multiset_hash, pack_histogram, pii_surrogates, pivotal_mix, simhash_ball
from quern.llm.common import stored


@pytest.fixture
def twins(rows):
    schema = "doc_id long, text string, lang string, source string, TEXT int, Doc_Id string, LANG int, Source int, `x.y` int"
    return rows(schema, *((i, f"some words of text {i}", "en", "s", 1, "a", 2, 3, 4) for i in range(8)), (None, None, None, None, None, None, None, None, None))


OPERATORS = {
    "op1": lambda s, d: lm_backoff.scores(d),
    "op2": lambda s, d: multiset_hash.compared(d),
    "op4": lambda s, d: lang_centroid.predicted(d, lang_centroid.fit(d)),
    "op5": lambda s, d: jpeg_media.described(jpeg_media.store(d)),
    "op6": lambda s, d: pivotal_mix.mix(d),
    "op7": lambda s, d: pack_histogram.pack(stored(pack_histogram.pieces(d, P.path("word_bpe_49k.json"), "word", 1), "t"), ["doc_id", "start"]),
    "op8": lambda s, d: pii_surrogates.replaced(d, "k"),
    "op9": lambda s, d: simhash_ball.near_duplicates(d),
    "similar": lambda s, d: simhash_ball.similar_documents(d),
    "op10": lambda s, d: framed_records.round_trip(s, d, P.path("byte_bpe_50k.json"), "byte", 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, twins, name):
    assert OPERATORS[name](spark, twins).count() == 9


def test_pages(rows):
    p = rows("page_id long, url string, html string, HTML int, Url int", (1, "http://a.b/", "<p>x", 1, 2))
    assert html_main_text.main_text(p).select("text").first()[0] == "x"


def test_other_columns_come_back(twins):
    got = pii_surrogates.replaced(twins, "k")
    assert got.columns == [*twins.columns, "pii_entities"]
    assert got.toDF(*(f"c{i}" for i in range(len(got.columns)))).filter(F.col("c4") == 1).count() == 8
