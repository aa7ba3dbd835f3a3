import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, length=10):
    """n_words, hit places, items of each text."""
    out = []
    for text in docs:
        own, hit, found = words(text), set(), set()
        for item, other in items:
            target = words(other)
            k = min(length, len(target))
            for i in range(len(target) - k + 1 if k else 0):
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == target[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add("" if item is None else str(item))
        out.append((len(own), hit, found))
    return out


def places(leaks):
    return {i for r in leaks["runs"] for i in range(r["first"], r["after"])}


@pytest.fixture
def benchmark(rows):
    long = " ".join(f"w{i}" for i in range(25))
    return rows(
        "item_id long, text string, leaks int", (1, "The Quick, brown fox; jumps over the lazy DOG again!", 1), (2, long, 1), (3, long, 1), (4, "two Words", 1), (5, None, 1), (6, "", 1),
        (7, "--- !!", 1), (8, "Ünïcode ßtraße 漢字 😀 ÀB", 1), (None, "w3 w4 w5", 1), (10, "a a a a a a a a a a a a", 1), (10, "solo-item", 1), (9, "one", 1),
    )


@pytest.fixture
def leaky(rows):
    long = " ".join(f"W{i}" for i in range(25))
    texts = [
        "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy cat again", "x " + long.replace(" ", "\n\n-- ") + " y",
        "w3,w4\tw5 two;words", None, "", "!!", "Ünïcode ßtraße 漢字 😀 Àb and ünïcode ßtraße 漢字 😀 àb", "a " * 11, "a " * 9, "nothing here", "ONE", "w3 w4\x00w5 w3w4w5", "solo item " * 3 + "two two words words",
    ]
    return rows("doc_id long, text string, leaks int, LEAKS_ string, `a.b` int", *((i if i != 3 else None, t, 1, "s", 2) for i, t in enumerate(texts)), (0, texts[0], 1, "s", 2))


@pytest.mark.parametrize("pairs", [d.PAIRS, 6])
def test_against_brute_force(leaky, benchmark, pairs):
    got = d.scanned(leaky, benchmark, pairs=pairs)
    assert got.columns == [*leaky.columns, "leaks__"]
    found = got.toDF(*(f"c{i}" for i in range(len(got.columns)))).select("c1", "c5").collect()
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert len(found) == leaky.count()
    for text, leaks in found:
        n, hit, ids = brute([text], items)[0]
        assert (leaks["n_words"], places(leaks), leaks["items"]) == (n, hit, sorted(ids))


def test_random_texts_and_spans(monkeypatch):
    rng = random.Random(5)
    marks = [" ", "\n", ", ", " - ", "  ", "\x00", "'"]
    some = lambda n: "".join(rng.choice(["a", "B", "c9", "é", "漢", "long" * 5]) + rng.choice(marks) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(12)]
    texts = [some(rng.randrange(0, 60)) + rng.choice(items)[1] + some(rng.randrange(0, 60)) for _ in range(60)] + ["", None]
    pairs = [(b" ".join(w.encode() for w in words(t)[i : i + 10]), str(k)) for k, t in items for i in range(max(1, len(words(t)) - 9)) if words(t)]
    own, want = d.Windows(pairs), brute(texts, items)
    for span in (1 << 20, 200, 30, 1):
        monkeypatch.setattr(d, "SPAN", span)
        count, runs, ids = own.scan([None if t is None else t.encode() for t in texts])
        assert [(n, {i for a, b in r for i in range(a, b)}, s) for n, r, s in zip(count, runs, ids)] == want


def test_windows_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(d.Windows, "hashes", staticmethod(lambda words, k: words[: max(0, len(words) - k + 1)] * 0 + 5))
    count, runs, ids = d.Windows([(b"a b", "1"), (b"c d", "2")]).scan([b"c d e a b", b"a c"])
    assert (count, runs, ids) == ([5, 2], [[(0, 2), (3, 5)], []], [{"1", "2"}, set()])


def test_removal(leaky, benchmark, rows):
    texts = rows("doc_id long, text string", (1, "Before it: The quick, brown fox jumps over the lazy dog again! And after this, there is much more of a text; really."), (2, "the quick brown fox jumps over the lazy dog again"), (3, "clean"), (4, None))
    found = d.scanned(texts, benchmark)
    got = {r["doc_id"]: r["text"] for r in d.cleaned(found).collect()}
    assert got == {1: "Before it: ! And after this, there is much more of a text; really.", 3: "clean", 4: None}
    assert {r["doc_id"] for r in d.cleaned(found, most=0).collect()} == {3, 4}


def test_empty_tables(spark, leaky, benchmark, no_docs):
    none = benchmark.limit(0)
    assert all(not r["leaks__"]["items"] for r in d.scanned(leaky, none).collect())
    assert d.scanned(no_docs, benchmark).count() == 0


def test_very_long_text(rows, benchmark):
    text = "filler words of no item " * 150_000 + "two words " + "filler words of no item " * 150_000
    got = d.scanned(rows("doc_id long, text string", (1, text)), benchmark, keep=["doc_id"]).first()
    assert (got["leaks"]["n_words"], places(got["leaks"]), got["leaks"]["items"]) == (1_500_002, {750_000, 750_001}, ["4"])
    assert got.asDict().keys() == {"doc_id", "leaks"}


def test_tables_match_the_library_regex(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = d.scanned(docs, spark.read.parquet(f"{tables}/benchmark.parquet")).select("text", F.col("leaks.n_words").alias("n")).collect()
    assert all(r["n"] == len(words(r["text"])) for r in got) and any(got)
