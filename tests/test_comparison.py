import json
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.plans import comparison, evaluation


@pytest.fixture
def runs(spark):
    rng = random.Random(4)
    some = lambda: [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(12)]), rng.choice(["x", "y", None, ""])) for _ in range(40)]
    left = some()
    right = [r for r in left if rng.random() < 0.8] + some()[:8]
    rng.shuffle(right)
    schema = "grp string, k int, v string"
    return left, right, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def test_comparison_against_brute_force(runs):
    left, right, a, b = runs
    own = lambda rows: {k: Counter(v for g, i, v in rows if (g, i) == k) for k in {r[:2] for r in rows}}
    x, y = own(left), own(right)
    want = {}
    for k in x.keys() | y.keys():
        state = "only_right" if k not in x else "only_left" if k not in y else "equal" if x[k] == y[k] else "changed"
        want[k] = state, sum(x.get(k, {}).values()), sum(y.get(k, {}).values())
    got = comparison.compared(a, b, ["grp", "k"], ["v"])
    assert {(r["grp"], r["k"]): (r["state"], r["n_left"], r["n_right"]) for r in got.collect()} == want and got.count() == len(want)
    counts = defaultdict(int)
    for (g, _), (s, _, _) in want.items():
        for key in ((g, s, 0), (g, None, 1), (None, s, 2), (None, None, 3)):
            counts[key] += 1
    expected = a.sparkSession.createDataFrame([("a",), ("zz",)], "grp string")
    rows = comparison.summary(got.select("grp", "state"), ["grp"], expected).collect()
    found = {(r["grp"], r["state"], r["level"]): r["keys"] for r in rows}
    assert found == {**counts, ("zz", "absent", 0): 0} and len(rows) == len(found)


def test_empty_runs(runs):
    _, _, a, b = runs
    assert {r["state"] for r in comparison.compared(a, b.limit(0), ["k"], ["v"]).collect()} == {"only_left"}
    assert comparison.compared(a.limit(0), b.limit(0), ["k"], ["v"]).count() == 0


def test_pairs_of_years_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("fgh"), rng.randrange(2000, 2008), rng.random() < 0.6) for i in range(60)]
    got = metrics.paired_years(spark.createDataFrame(rows, "question_no int, family string, case_year int, exact boolean"))
    want = set()
    for no, family, year, exact in rows:
        before = [r for r in rows if r[1] == family and r[2] < year]
        if before:
            last = max(before, key=lambda r: (r[2], r[0]))
            want.add((family, no, year, last[0], year - last[2], exact, last[3]))
    assert {tuple(r) for r in got.collect()} == want
    for r in metrics.paired_consistency(got).collect():
        own = [w for w in want if w[4] == r["gap"]]
        both, lost = sum(w[5] and w[6] for w in own), sum(w[6] and not w[5] for w in own)
        assert (r["pairs"], r["both"], r["lost"]) == (len(own), both, lost)
        assert r["kept"] == (pytest.approx(both / (both + lost), abs=1e-6) if both + lost else None)


@pytest.mark.parametrize(
    "gold,predicted,unit,found,kind",
    [
        ("100", "100.00", True, False, "right"), ("100", "100", False, True, "wrong unit"), ("100", None, True, True, "no answer"), ("100", " ", True, True, "no answer"),
        ("none", "none", None, None, "right"), ("none", "5", True, True, "missed abstention"), ("5", "none", True, True, "false abstention"), ("100", "7", True, False, "evidence not found"),
        ("10000", "10001", True, True, "rounding"), ("100", "100000", True, True, "factor"), ("100", "10", True, True, "factor"), ("100", "77", True, True, "other value"), ("abc", "abc", True, True, "right"), ("100", "abc", True, True, "other value"),
    ],
)
def test_kinds_of_error(spark, gold, predicted, unit, found, kind):
    row = spark.createDataFrame([(gold, predicted, unit, found)], "g string, p string, u boolean, f boolean")
    assert row.select(metrics.error_kind(F.col("g"), F.col("p"), F.col("u"), F.col("f"), "none")).first()[0] == kind


def test_outputs_of_a_run(spark, rows, tmp_path):
    """Records by number, a summary and a comparison with a base condition, against plain counts."""
    random.seed(5)
    made = [(c, no, "10", random.choice(["10", "11", None])) for c in ("base", "rag", "other") for no in random.sample(range(60), 40)]
    records = rows("condition string, no int, answer_value string, pred_value string", *made)
    evaluation.write_run(records, f"file://{tmp_path}/run", {"country": "KZ", "split": "dev"}, base="base")
    files = sorted(p for p in os.listdir(tmp_path / "run" / "records" / "condition=rag") if p.startswith("part-"))
    numbers = [json.loads(line)["no"] for f in files for line in open(tmp_path / "run" / "records" / "condition=rag" / f)]
    assert numbers == sorted(no for c, no, _, _ in made if c == "rag")
    summary = {r.condition: (r.country, r.split, r.total, r.em) for r in spark.read.json(f"file://{tmp_path}/run/summary").collect()}
    assert summary == {c: ("KZ", "dev", 40, sum(x[3] == "10" for x in made if x[0] == c) / 40) for c in ("base", "rag", "other")}
    ok = {c: {no: p == "10" for d, no, _, p in made if d == c} for c in ("base", "rag", "other")}
    for r in spark.read.json(f"file://{tmp_path}/run/comparison").collect():
        a, b = ok[r.condition], ok["base"]
        both = a.keys() & b.keys()
        want = sum(a[n] and b[n] for n in both), sum(not a[n] and not b[n] for n in both), sum(a[n] and not b[n] for n in both), sum(b[n] and not a[n] for n in both), len(a.keys() - both), len(b.keys() - both)
        assert (r.both, r.neither, r.gained, r.lost, r.only_here, r.only_base) == want and r.base == "base"
    assert evaluation.paired(records.filter("condition = 'base'"), "base").count() == 0
    assert evaluation.paired(records.limit(0), "base").count() == 0
