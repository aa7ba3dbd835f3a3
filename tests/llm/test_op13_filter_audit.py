import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from quern.llm import filter_audit as a


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rules = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text) is not None]
    return {f for f, bad in zip("ABCD", rules) if bad}


def brute(docs, labels):
    """Rows by applying every order, one filter after the other."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    known = [(i, t or "", p or "") for i, t, p in docs]
    rows = []
    for i, text, part in known:
        own = fails(text)
        if i is not None and any(o is not None and o < i and u == text for o, u, _ in known):
            own.add("E")
        rows.append((i, part, own))
    out = {}
    for part in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[2]], [r for r in left if f not in r[2]]
                sums[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in r[2] for r in own) - len(gone), sum(r[2] == {f} for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in a.audit(docs, labels).collect()}


LABELS = "doc_id long, quality int, toxic int, mask int"


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "Bee", "see", "dee", "E", "#", "été", "漢字"]

    def text():
        kind = rng.randrange(6)
        if kind == 0:
            return rng.choice([None, "", " ", "\t\n"])
        if kind == 1:
            return "copy of " + rng.choice("xy")
        n = rng.choice([5, 199, 200, 230])
        return rng.choice([" ", "\n", "\x0b", "\xa0"]).join(rng.choice(words[: rng.randrange(1, 8)]) if kind < 4 else f"w{i}" for i in range(n))

    docs = [(rng.choice([None, *range(150)]) if rng.random() < 0.1 else i, text(), rng.choice(["en", "de", None])) for i in range(150)]
    docs += [docs[5], docs[5], (docs[5][0], docs[5][1], "fr"), (None, docs[5][1], "en")]
    labels = [(rng.randrange(160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, lang string, mask int, `part.n` int, PART string").repartition(5)
    got = audited(frame, spark.createDataFrame([(*x, 9) for x in labels], LABELS))
    assert got == brute(docs, labels)


def test_odd_documents(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1, 1, 0), (5, 1, 0, 0), (6, 0, 1, 0)], LABELS)
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.select("doc_id", "text", "lang").collect()]
    assert audited(odd, labels) == brute(docs, [(1, 1, 1), (5, 1, 0), (6, 0, 1)])
    assert audited(no_docs, labels) == {}
    assert {v[4] for v in audited(odd, labels.limit(0)).values()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_polynomial(seed):
    rng = random.Random(seed)
    counts = {m: rng.randrange(20) for m in range(32) if rng.random() < 0.6}
    p = a.Removal(counts)
    for t in range(32):
        assert p.corner[t] == sum(n for m, n in counts.items() if m & t)
    for i in range(5):
        assert p.shapley(i) == sum((Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1), Fraction(0))


def test_bounds_of_the_filters(spark):
    texts = {"200": " ".join(f"w{i}" for i in range(200)), "half": " ".join(["a", "b"] * 2), "most": "a a a a b", "caps": "A" * 3 + "x" * 97, "more": "A" * 4 + "x" * 96, "mark": "x|y", "": "\x0b \f"}
    got = spark.createDataFrame(list(texts.items()), "k string, text string").select("k", a.text_mask(a.F.col("text")).alias("m")).collect()
    assert {r["k"]: r["m"] for r in got} == {"200": 0, "half": 1, "most": 3, "caps": 1, "more": 5, "mark": 9, "": 1}
