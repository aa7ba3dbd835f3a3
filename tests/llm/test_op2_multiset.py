import hashlib
import math
import random
import re
import string
import struct

import pytest
from pyspark.sql import functions as F

from quern.llm import multiset_hash as m


def lanes_of(spark, **texts):
    df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"t_{n} string" for n in texts))
    return m.with_lanes(df, **{n: f"t_{n}" for n in texts})


def test_order_does_not_matter_and_content_does(spark):
    df = lanes_of(spark, a="one x\ntwo y\nthree z", b="three z\none x\ntwo y", c="one x\ntwo y\nthree zz", d="one x\none x\ntwo y\nthree z")
    r = df.select(*(m.to_hex(F.col(n)).alias(n) for n in "abcd")).first()
    assert r["a"] == r["b"] and len({r["a"], r["c"], r["d"]}) == 3


def test_insertion_and_deletion(spark):
    df = lanes_of(spark, whole="p one.\np two, and\np three", part="p one.\np three", rest="p two, and")
    plus = m.combine(F.col("part"), F.col("rest"))
    minus = m.combine(F.col("whole"), F.col("rest"), -1)
    r = df.select(m.to_hex(plus).alias("plus"), m.to_hex(minus).alias("minus"), m.to_hex(F.col("whole")).alias("whole"), m.to_hex(F.col("part")).alias("part")).first()
    assert r["plus"] == r["whole"] and r["minus"] == r["part"]


def test_likeness_follows_the_share_of_equal_clauses(spark):
    base = [f"clause number {i} says this." for i in range(400)]
    other = [f"other clause {i} of that." for i in range(400)]
    texts = {f"x{k}": "\n".join(base[: 400 - k] + other[:k]) for k in (0, 40, 200, 400)}
    df = lanes_of(spark, base="\n".join(base), **texts)
    r = df.select(*(m.likeness(F.col("base"), F.col(n)).alias(n) for n in texts)).first()
    assert r["x0"] == 1.0
    assert abs(r["x40"] - 0.9) < 0.06 and abs(r["x200"] - 0.5) < 0.2 and r["x400"] < 0.3


def test_edited_text_is_the_brute_force_one(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    got = m.compared(odd).select("doc_id", F.char_length("text").alias("n"), F.sha2("edited_text", 256).alias("s")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_equal_texts_are_equal_and_empty_table_is_empty(odd, no_docs):
    rows = m.compared(odd).select("text", m.to_hex(F.col("fp")).alias("h"), m.likeness(F.col("fp"), F.col("edited_fp")).alias("l"))
    got = rows.collect()
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add(r["h"])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert all(0 <= r["l"] <= 1 for r in got)
    assert m.compared(no_docs).count() == 0


def test_single_row_and_only_null_ids(rows):
    one = m.compared(rows("doc_id long, text string", (1, "abcd"))).first()
    assert one["edited_text"] == "abab"
    nulls = m.compared(rows("doc_id long, text string", (None, "aaaa"), (None, "bbbb"))).collect()
    assert sorted(r["edited_text"] for r in nulls) == ["aabb", "bbaa"]


MASK = (1 << 64) - 1


def plain_pieces(text):
    out = []
    for x in re.split(rf"\n|(?<=[.!?,;:|])[ \t\n\x0b\f\r]|(?<=[{m.SIGNS}])", text):
        for y in _after_letters(x) if len(x) > m.LONG else [x]:
            for z in re.split(r"[ \t\n\x0b\f\r]", y) if len(y) > m.LONGEST else [y]:
                out += re.split(rf"(?<=[{m.HALF}]{{3}}[^{m.HALF}]{{2}})", z) if len(z) > m.LONGEST else [z]
    return [x for x in out if x]


def _after_letters(x):
    import regex

    return regex.split(rf"(?<=[{m.LETTERS}][\p{{P}}\p{{S}}]{{0,4}})[ \t\n\x0b\f\r]", x)


def plain_lanes(text):
    """(identity lanes, cells, pieces) by plain loops."""
    from xxhash import xxh64_intdigest

    identity, cells, n = [0] * m.IDENTITY, [0] * (m.LEVELS * m.CELLS), 0
    for paragraph in text.split("\n"):
        digest = hashlib.sha512(paragraph.encode()).hexdigest().encode()
        for i in range(m.IDENTITY):
            identity[i] += xxh64_intdigest(struct.pack("<i", i), xxh64_intdigest(digest, 42)) & 0xFFFFFFFF
    for piece in plain_pieces(text):
        h = xxh64_intdigest(piece.encode(), 42)
        level = 0
        while level < m.LEVELS - 1 and not h >> level & 1:
            level += 1
        cells[level * m.CELLS + (h >> 40) % m.CELLS] += h >> 20 & 0xFFFF | 1
        n += 1
    return [x & 0xFFFFFFFF for x in identity], [x & 0xFFFF for x in cells], n


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    found = share = 0.0
    for level in reversed(range(m.LEVELS)):
        d = sum(x != y for x, y in zip(a[1][level * m.CELLS :][: m.CELLS], b[1][level * m.CELLS :][: m.CELLS]))
        if d > m.CELLS - 2:
            break
        found += -math.log1p(-d / m.CELLS) * m.CELLS
        share += 0.5 ** min(level + 1, m.LEVELS - 1)
    both = a[2] + b[2]
    return max(0.0, min(1 - found / share / both if both and share else 0.0, 1 - 2.0**-20))


KINDS = {"base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789abcdef", "sequence": "ACGT"}


def unbroken(kind, n, seed):
    return "".join(random.Random(f"{kind}{seed}").choices(KINDS[kind], k=n))


@pytest.mark.parametrize("kind", KINDS)
def test_unbroken_texts_are_alike_if_half_is_equal(spark, kind):
    """The estimate of one pair spreads by some 0.07, so the mean of twelve is held against the true shares."""
    texts = []
    for i in range(12):
        base, other = unbroken(kind, 5000, f"a{i}"), unbroken(kind, 5000, f"b{i}")
        texts.append((base, base[:2500] + other[:2500], "x" + base, other))
    df = m.with_lanes(spark.createDataFrame(texts, "t_base string, t_half string, t_moved string, t_other string"), base="t_base", half="t_half", moved="t_moved", other="t_other")
    mean = lambda n: F.avg(m.likeness(F.col("base"), F.col(n))).alias(n)
    r = df.select(*map(mean, ("half", "moved", "other"))).first()
    assert abs(r["half"] - 0.5) < 0.1 and r["moved"] > 0.95 and r["other"] < 0.15


def test_fingerprints_and_likenesses_equal_brute_force(rows, documents):
    texts = [r["text"] for r in documents.limit(40).collect()] + ["", "a", "Im " * 500, "漢字の文章です。" * 30, "word### " * 80, "один два три " * 40, *(unbroken(kind, 700, 1) for kind in KINDS), "A" * 999, "Ab" * 300]
    docs = rows("doc_id long, text string", *enumerate(texts))
    h = lambda c: m.to_hex(F.col(c)).alias(f"h_{c}")
    got = m.compared(docs).select("doc_id", "edited_text", h("fp"), h("edited_fp"), h("next_fp"), m.likeness(F.col("fp"), F.col("edited_fp")).alias("le"), m.likeness(F.col("fp"), F.col("next_fp")).alias("ln"))
    as_hex = lambda x: "".join(f"{v:08x}" for v in x[0]) + "".join(f"{i:04x}{v:04x}" for i, v in enumerate(x[1]) if v) + f"{x[2]:08x}"
    for r in got.collect():
        own, edited, after = plain_lanes(texts[r["doc_id"]]), plain_lanes(r["edited_text"]), plain_lanes(texts[(r["doc_id"] - 1) % len(texts)])
        assert (r["h_fp"], r["h_edited_fp"], r["h_next_fp"]) == (as_hex(own), as_hex(edited), as_hex(after))
        assert r["le"] == pytest.approx(plain_likeness(own, edited), abs=1e-9) and r["ln"] == pytest.approx(plain_likeness(own, after), abs=1e-9)


@pytest.mark.parametrize("unit", ["Im ", "word### ", "漢字の文章です。", "aab cde fgh ", "no marks here at all "])
def test_texts_without_marks_are_alike_if_half_is_equal(spark, unit):
    base = "".join(f"{unit}{i * 7919 % 1000} " for i in range(300))
    other = "".join(f"{unit[::-1]}{i * 6007 % 1000}x " for i in range(300))
    half = base[: len(base) // 2] + other[: len(base) // 2]
    df = lanes_of(spark, base=base, half=half, other=other)
    r = df.select(m.likeness(F.col("base"), F.col("half")).alias("h"), m.likeness(F.col("base"), F.col("other")).alias("o")).first()
    assert 0.25 < r["h"] < 0.85 and r["h"] > r["o"]


def test_many_differing_pieces(spark):
    """Far over 60,000 differing pieces: the likeness still tells a half from nothing."""
    base = [f"piece {i}." for i in range(300_000)]
    other = [f"thing {i}." for i in range(300_000)]
    df = lanes_of(spark, base="\n".join(base), half="\n".join(base[:150_000] + other[150_000:]), none="\n".join(other))
    r = df.select(m.likeness(F.col("base"), F.col("half")).alias("h"), m.likeness(F.col("base"), F.col("none")).alias("n")).first()
    assert abs(r["h"] - 0.5) < 0.2 and r["n"] < 0.3
