import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import temporal
from quern.operators import allocation, chunks, metrics, retrieval, search, validation


def corpus(rows):
    return rows("chunk_id string, source_id string, title string, text string", ("a_c0", "a", "Law 2020", "income tax rate is ten"), ("a_c1", "a", "Law 2020", "property tax on land"), ("b_c0", "b", "Act 2019", "tax tax tax"), ("c_c0", "c", "Other", ""))


def test_bm25_is_the_formula(rows):
    c, q = corpus(rows), rows("query_id int, query string, case_year int", (1, "tax on land land", 2020), (2, "nothing here", 2019))
    docs = {r["chunk_id"]: r["text"].split() for r in c.collect()}
    toks = {k: [t for w in v for t in ([w, "#" + w[:5]] if len(w) >= 6 else [w])] for k, v in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for k, t in toks.items():
        tf, s = Counter(t), 0.0
        for term in {"tax", "on", "land"}:
            df = sum(term in x for x in toks.values())
            if tf[term]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[k] = round(s, 6)
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25(c, q).filter("query_id = 1").collect()}
    assert got == pytest.approx(want, abs=2e-6)
    top = retrieval.top(retrieval.bm25(c, q), 1).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in top] == [(1, "a_c1", 1)]
    boosted = {r["chunk_id"]: r["score"] for r in retrieval.boosted(retrieval.bm25(c, q), c, q).filter("query_id = 1").collect()}
    assert boosted["a_c1"] == pytest.approx(1.25 * got["a_c1"], abs=1e-5) and boosted["b_c0"] == got["b_c0"]


def weight(meta, case, codes):
    eff, snap, code, budget = meta
    if eff is None:
        return 0.6
    if eff > case:
        return 0.05
    if code:
        return 0.1 if eff < max(y for y in codes if y <= case) else 2.5 if abs(snap - case) <= 2 else 2.0
    if budget:
        return 2.4 if eff <= case <= snap + 1 else 0.1
    return 1.5 / (1 + 0.08 * max(0, case - snap))


def test_time_aware_ranking_is_the_brute_force_one(rows):
    texts = {f"{kind} {y}": ("tax " * (1 + y % 3) + "rate of land " * (y % 2) + "x " * (y % 7), y) for y in range(2004, 2016) for kind in ("Income Tax Ordinance", "Finance Act", "Law")}
    docs = [(f"d{i:02d}", f"d{i:02d}", title, t) for i, (title, (t, _)) in enumerate(texts.items())]
    c = rows("chunk_id string, source_id string, title string, text string", *docs)
    q = rows("query_id int, query string, case_year int", (1, "land tax", 2010), (2, "tax rate", 2013), (3, "x tax", 2004))
    meta = temporal.metadata(rows("id string, title string, raw_path string", *((d[0], d[2], None) for d in docs)))
    info = {r["id"]: (r["y_eff"], r["y_snap"], r["is_code"], r["is_budget"]) for r in meta.collect()}
    codes = sorted({m[0] for m in info.values() if m[2]})
    titles, cases = {d[0]: d[2] for d in docs}, {1: 2010, 2: 2013, 3: 2004}
    want = {}
    for r in retrieval.bm25(c, q).collect():
        case = cases[r["query_id"]]
        boost = 1.25 if str(case) in titles[r["chunk_id"]] else 1.0
        want[r["query_id"], r["chunk_id"]] = r["score"] * boost * weight(info[r["chunk_id"]], case, codes)
    got = retrieval.boosted(retrieval.bm25(c, q), c, q, meta)
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got.collect()} == pytest.approx(want, abs=2e-6)
    best = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.top(got, 5).collect()}
    for i in cases:
        order = sorted((k[1] for k in want if k[0] == i), key=lambda d: (-round(want[i, d], 6), d))[:5]
        assert [best[i, n + 1] for n in range(5)] == order


def test_parameters_are_injected_at_two(rows):
    ranked = rows("query_id int, chunk_id string, score double, rank int", *((1, f"x{i}", 9.0 - i, i) for i in range(1, 6)))
    q, p = rows("query_id int, case_year int", (1, 2020)), rows("case_year int, chunk_id string, source_id string", (2020, "par", "s"))
    got = [(r["rank"], r["chunk_id"], r["score"]) for r in retrieval.injected(ranked, q, p, 5).orderBy("rank").collect()]
    assert got == [(1, "x1", 8.0), (2, "par", 999.0), (3, "x2", 7.0), (4, "x3", 6.0), (5, "x4", 5.0)]
    assert retrieval.injected(ranked.filter("rank <= 2"), q, p, 2).count() == 2
    there = rows("case_year int, chunk_id string, source_id string", (2020, "x3", "s"))
    assert retrieval.injected(ranked, q, there, 5).orderBy("rank").first()["chunk_id"] == "x1"


def test_fusion(rows):
    pool = rows("query_id int, chunk_id string, rank int", (1, "a", 1), (1, "b", 2), (1, "c", 3))
    v = rows("chunk_id string, vector array<double>", ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", None))
    q = rows("query_id int, vector array<double>", (1, [1.0, 0.1]))
    dense = [r["chunk_id"] for r in retrieval.reranked(pool, v, q, "dense", 3).orderBy("rank").collect()]
    fused = retrieval.reranked(pool, v, q, "hybrid", 3).orderBy("rank").collect()
    assert dense == ["b", "a", "c"] and [r["chunk_id"] for r in fused] == ["a", "b", "c"]
    assert fused[0]["score"] == round(1 / 61 + 1 / 62, 6)


def test_nearest(rows):
    v = rows("vec_id long, embedding array<float>", *((i, [math.cos(i), math.sin(i)]) for i in range(50)), (99, None))
    got = retrieval.nearest(v, v.filter("vec_id in (3, 7, 99)"), 4, block=8).collect()
    for q in (3, 7):
        want = sorted(range(50), key=lambda i: (-round(math.cos(i - q), 5), i))[:4]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert {r["query_id"] for r in got} == {3, 7}


def test_hits(rows):
    got = rows("query_id int, rank int, source_id string, text string", (1, 1, "s_a", "nothing"), (1, 2, "s_b", "The  Gold\npassage is here"), (2, 1, "s_c", "x"))
    gold = rows("query_id int, source_file string, passage string", (1, "raw/s_b.html", "gold passage"), (1, "s_z", ""), (2, "s_c", "y" * 50))
    r = {x["query_id"]: tuple(x)[1:] for x in retrieval.hits(got, gold).collect()}
    assert r == {1: (0.5, 0, 0.5, 0.5), 2: (0.0, 0, 1.0, 0.0)}


def test_metrics(rows):
    recs = rows(
        "family string, variant string, gold_answer string, pred_value string, year_period_target string",
        ("F1", "original", "10", "10.00", "p"), ("F1", "missing_information", "insufficient information", "Insufficient information", "p"), ("F2", "numbers", "5", "insufficient information", "q"), ("F3", "missing_information", "insufficient information", "3", "q"),
    )
    s = metrics.scored(recs)
    o = metrics.overall(s).first()
    assert (o["total"], o["solvable_total"], o["em"], o["solvable_em"], o["abstention_accuracy"], o["false_abstention_rate"]) == (4, 2, 0.5, 0.5, 0.5, 0.5)
    assert tuple(metrics.family_consistency(s).first()) == (3, 1)
    assert {r["year_period_target"]: (r["total"], r["solvable"], r["em"]) for r in metrics.by_period(s).collect()} == {"p": (2, 1, 1.0), "q": (2, 1, 0.0)}
    assert {r["variant"]: r["em"] for r in metrics.by_variant(s).collect()} == {"original": 1.0, "missing_information": 0.5, "numbers": 0.0}
    assert metrics.confusion(s).first()["macro_f1"] == 0.5
    e = metrics.overall(s.filter("false")).first()
    assert e["total"] == 0 and e["em"] == 0.0


@pytest.mark.parametrize("total,weights,want", [(25, [1] * 6, [5, 4, 4, 4, 4, 4]), (125, [75, 25, 25], [75, 25, 25]), (7, [0.5, 0.5], [4, 3]), (0, [1, 2], [0, 0])])
def test_shares(rows, total, weights, want):
    assert allocation.shares(total, weights) == want
    g = rows("grp int, pos int, item string, weight long", *((1, i, f"i{i}", int(w * 2)) for i, w in enumerate(weights)))
    got = allocation.apportioned(g, rows("grp int, total long", (1, total))).orderBy("item").collect()
    assert [r["share"] for r in got] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 500), st.lists(st.integers(0, 50), min_size=1, max_size=8).filter(any))
def test_shares_are_exact_and_fair(total, weights):
    got = allocation.shares(total, weights)
    assert sum(got) == total and all(abs(g - total * w / sum(weights)) < 1 for g, w in zip(got, weights))


def test_slots():
    cats = [(f"c{i}", 1) for i in range(6)]
    periods = [("recent", 3), ("middle", 1), ("early", 1)]
    assert sorted(Counter(allocation.category_slots(cats, 50)).values()) == [8, 8, 8, 8, 9, 9]
    slots = allocation.period_slots(periods, 50, 5)
    assert Counter(p for s in slots for p in s) == {"recent": 150, "middle": 50, "early": 50}
    assert all(len(set(s)) == 3 for s in slots)
    assert sorted(allocation.period_slots(periods, 1, 5)[0]) == sorted(["recent", "middle", "early", "recent", "recent"])
    with pytest.raises(ValueError):
        allocation.period_slots(periods, 1, 2)


def test_assignments(spark):
    got = allocation.assignments(spark, "A", [("x", 1), ("y", 1)], [("p", 1), ("q", 1)], 3, 4, 1).collect()
    assert [r["question_no"] for r in got] == list(range(1, 16)) and {r["family_id"] for r in got} == {"A-F01", "A-F02", "A-F03"}
    assert sum(r["is_missing"] for r in got) == 3


def test_splits(rows):
    r = rows("pos int, family string, category string", (1, "F01", "A"), (2, "F02", "A"), (3, "F03", "B"), (4, "F04", "C"))
    assert {x["family"] for x in allocation.balanced_families(r, 3).filter("picked").collect()} == {"F01", "F03", "F04"}
    assert {x["family"] for x in allocation.split(r, 3, "test").collect()} == {"F02"} and allocation.split(r, 3, "full").count() == 4
    with pytest.raises(ValueError):
        allocation.split(r, 3, "nope")


def test_coverage_and_options(rows):
    q = rows("category string, period string, is_missing boolean", ("a", "p", False), ("a", "p", True))
    t = rows("category string, period string, target long", ("a", "p", 1), ("b", "p", 2))
    got = {(r["category"], r["regular"], r["missing"], r["issue"]) for r in allocation.coverage(q, t).collect()}
    assert got == {("a", 1, 1, None), ("b", 0, 0, "too few")}
    o = allocation.category_options(rows("category string, n long", ("a", 3)), rows("category string, target long", ("a", 2), ("b", 1)))
    assert {r["category"]: r["feasible"] for r in o.collect()} == {"a": False, "b": True}
    assert allocation.overlapping_periods(rows("label string, start int, `end` int", ("a", 1, 3), ("b", 3, 4), ("c", 6, 5))).count() == 2


def test_chunks(rows):
    text = "pre\nСтатья 1. One\nbody\nСтатья 2. " + "long words here " * 300
    got = chunks.chunked(rows("id string, title string, text string", ("d", "t", text), ("e", "t", ""), ("f", "t", None), ("g", "t", "x" * 4500))).collect()
    d = [r["text"] for r in got if r["source_id"] == "d"]
    assert d[0] == "pre" and d[1] == "Статья 1. One\nbody" and d[2].startswith("Статья 2.") and all(" (cont.)\n" in x for x in d[3:]) and len(d) == 5
    assert [r["chunk_id"] for r in got if r["source_id"] == "g"] == ["g_c0", "g_c1"] and not [r for r in got if r["source_id"] in "ef"]


def test_lines_and_sections(rows):
    docs = rows("id int, text string", (1, "a\r\nbb\x0bccc\n"), (2, "Article 1. x\ny\nArticle 2. z\nw"), (3, None))
    got = [(r["line_no"], r["start"], r["line"]) for r in chunks.lines(docs).filter("id = 1").orderBy("line_no").collect()]
    assert got == [(1, 0, "a"), (2, 3, "bb"), (3, 6, "ccc")]
    spans = chunks.section_spans(docs).orderBy("section").collect()
    assert [(r["start"], r["end"], r["label"]) for r in spans] == [(0, 15, "Article 1. x"), (15, 29, "Article 2. z")]
    listed = {r["label"]: r["first_line"] for r in search.list_sections(docs).collect()}
    assert listed == {"Article 1. x": 1, "Article 2. z": 3}
    wanted = rows("id int, label string", (2, "Article 2. z"), (2, "Article 9"))
    assert {r["label"]: (r["text"], r["issue"]) for r in search.read_sections(docs, wanted).collect()} == {"Article 2. z": ("Article 2. z\nw", None), "Article 9": (None, "none")}
    q = rows("quote_id int, id int, q_start int, q_end int", (1, 2, 16, 20))
    assert search.smallest_section(docs, q).first()["label"] == "Article 2. z"


def test_gaps_withhold_their_section(rows):
    docs = rows("id int, text string", (1, "Article 1. a\nok\nArticle 2. b\n[GAP: img] c\nArticle 3. d"), (2, "[GAP: x]\nArticle 1. a"))
    a, b = chunks.withheld(docs).orderBy("id").collect()
    assert a["text"] == "Article 1. a\nok\n[UNAVAILABLE PROVISION: Article 2. b]\nArticle 3. d" and a["gaps"] == ["Article 2. b"] and not a["gap_outside_section"]
    assert b["gap_outside_section"]


def test_search(rows):
    docs = rows("id int, text string", (1, "the tax\non land\nis due"), (2, "land tax 35 due"), (3, "a land tax"), (4, "135 land taxes"))
    got = [(r["id"], r["line_no"], r["rank"]) for r in search.find(docs, "land tax").orderBy("rank", "id").collect()]
    assert got == [(2, 1, 0), (3, 1, 0), (1, 1, 2)]
    assert {r["id"] for r in search.find(docs, "35").collect()} == {2} and {r["id"] for r in search.find(docs, "tax*").collect()} == {1, 2, 3, 4}
    for bad in ("35*", "*tax", "ta**", "t*x", "*", "tax*35"):
        with pytest.raises(ValueError):
            search.query_patterns(bad)
    many = rows("id int, text string", *((i, f"land tax {i}\nnext\nland tax again") for i in range(30)))
    best = search.best_hits(search.find(many, "land tax")).collect()
    assert len(best) == 6 and len({(r["id"], r["line_no"]) for r in best}) == 6


def test_reading_lines(rows):
    docs = rows("id int, text string", (1, "a\nb\nc"))
    spans = rows("span_id int, id int, start_line int, end_line int", (1, 1, 2, 3), (2, 1, 3, 2), (3, 1, 9, 9), (4, 1, 1, 500))
    assert {r["span_id"]: (r["text"], r["issue"]) for r in search.read_lines(docs, spans).collect()} == {1: ("b\nc", None), 2: (None, "bad span"), 3: (None, "no such lines"), 4: (None, "bad span")}


def question(**change):
    base = dict(no=1, family="F", variant="original", country="KZ", language="ru", tax_category="1000", primary_taxpayer="Individual", year_period_target="p", case_year=2024, difficulty="D2",
                question="q", final_answer_text="a", answer_value="10", unit="KZT", status="draft", note=None)
    return tuple((base | change).values())


def test_question_rules(rows):
    schema = "no int, family string, variant string, country string, language string, tax_category string, primary_taxpayer string, year_period_target string, case_year int, difficulty string, question string, final_answer_text string, answer_value string, unit string, status string, note string"
    changes = [{}, {"no": 0}, {"variant": "x"}, {"tax_category": "7"}, {"unit": "GBP"}, {"answer_value": "1,0"}, {"note": " "}, {"case_year": 0}, {"variant": "missing_information"},
               {"variant": "missing_information", "answer_value": None, "unit": None, "final_answer_text": "Insufficient information"}]
    df = rows(schema, *(question(**c | ({"no": i + 1} if "no" not in c else {})) for i, c in enumerate(changes)))
    got = {(r["key"], r["rule"]) for r in validation.violations(df, F.col("no"), validation.question_rules()).collect()}
    assert got == {("0", "number"), ("3", "variant"), ("4", "category"), ("5", "unit"), ("6", "answer"), ("7", "blank"), ("8", "year"), ("9", "missing answer")}


def test_citation_rules(rows):
    df = rows("k int, citation_id string, supporting_passage string, rule_applies_from string, rule_applies_until string", (1, "C1", "p", "2025-01-01", None), (2, "C0", " ", "2025-02-30", "2025/01/01"), (3, "C2", "p", "2025-02-01", "2025-01-01"))
    got = {(r["key"], r["rule"]) for r in validation.violations(df, F.col("k"), validation.citation_rules()).collect()}
    assert got == {("2", "citation id"), ("2", "passage"), ("2", "from"), ("2", "until"), ("3", "order")}


def test_sources_steps_and_passages(rows):
    docs = rows("id string, raw_path string, text string", ("s_a", "x", "The rate is 10."), ("s_b", "y", "t"), ("s_c", "y", "t"))
    cits = rows("question_no int, citation_id string, source_file string, supporting_passage string", (1, "C1", "text/s_a.txt", "rate  is"), (1, "C2", "x", "rate is 11"), (1, "C3", "y", "t"), (1, "C4", "z", "t"))
    r = validation.resolved_sources(cits, docs)
    assert {x["citation_id"]: (x["document_id"], x["source_issue"]) for x in r.collect()} == {"C1": ("s_a", None), "C2": ("s_a", None), "C3": (None, "ambiguous"), "C4": (None, "unknown")}
    b = {x["citation_id"]: (x["passage"], x["issue"]) for x in validation.bound_passages(r, docs).collect()}
    assert b["C1"] == ("rate is", None) and b["C2"] == (None, "not found once") and b["C4"] == (None, "no source")
    q = rows("no int, gold_steps array<struct<step:string,citations:array<string>>>", (1, [("a", ["C1", "C9"])]), (2, [("a", [])]))
    assert {(x["no"], tuple(x["missing"]), x["empty_step"]) for x in validation.unknown_step_citations(q, cits).collect()} == {(1, ("C9",), False), (2, (), True)}


def test_duplicates_reviews_and_plans(rows):
    q = rows("family string, no int, question string, steps string, variant string", ("A", 1, "Pay  10?", "s", "original"), ("A", 2, "pay 20?", "s", "numbers"), ("A", 3, "pay 30?", "s", "temporal"), ("B", 4, "PAY 10?", "z", "original"))
    assert [tuple(r) for r in validation.duplicate_questions(q).collect()] == [("B", 4, "A")]
    assert [tuple(r) for r in validation.near_duplicates(q).collect()] == [("A", 2)]
    qs = rows("no int, answer_value string, unit string, author string", *((i, "10", "KZT", "w") for i in range(1, 8)))
    rs = rows("question_no int, reviewer string, passed boolean, recomputed_answer string, unit string", (1, "r", True, "10.0", "kzt"), (2, "w", True, "10", "KZT"), (3, "r", False, "10", "KZT"), (4, "r", True, "11", "KZT"), (5, "r", True, "10", "USD"), (6, "r", True, "10", "KZT"), (6, "x", True, "10", "KZT"), (9, "r", True, "1", "KZT"))
    assert {tuple(r) for r in validation.review_failures(qs, rs).collect()} == {(2, "own review"), (3, "not passed"), (4, "other answer"), (5, "other unit"), (6, "reviewed more than once"), (7, "not reviewed"), (9, "review of no question")}
    plan = rows("question_no int, pos int, variant string, derived_from int, legal_parameters array<string>", (1, 1, "original", None, ["x"]), (2, 2, "numbers", 1, ["x"]), (3, 3, "numbers", 4, ["x"]), (4, 4, "missing_information", 1, []), (5, 5, "numbers", 4, ["x"]), (6, 6, "numbers", 99, ["x"]), (7, 7, "temporal", 1, []))
    assert {tuple(r) for r in validation.plan_failures(plan).collect()} == {(3, "parent comes later"), (5, "parent is not regular"), (6, "no parent"), (7, "no legal parameter")}
    t = rows("no int, variant string, derived_from int, template string, case_year int", (1, "original", None, "T", 2020), (2, "temporal", 1, "T", 2021), (3, "temporal", 1, "U", 2021), (4, "temporal", 1, "T", 2020))
    assert {tuple(r) for r in validation.temporal_pairs(t).collect()} == {(3, "other template"), (4, "same year")}


def test_sets(rows):
    old, new = rows("k int, v string", (1, "a"), (2, "b")), rows("k int, v string", (2, "c"), (3, "d"))
    assert {tuple(r) for r in validation.upserted(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r["v"] for r in validation.first_rows(rows("k int, pos int, v string", (1, 2, "b"), (1, 1, "a")), ["k"], "pos").collect()] == ["a"]
    spans = rows("id int, start int, `end` int", (1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11))
    assert {tuple(r) for r in search.merged_spans(spans).collect()} == {(1, 0, 7), (1, 9, 12)}


def test_read_lines_give_the_gaps_they_meet(rows):
    docs = rows("id long, text string", (1, "one\ntwo [GAP]\nthree\nfour"), (2, "x"))
    gaps = rows("id long, gaps array<struct<label:string,reason:string,`start`:int,`end`:int>>", (1, [("g", "image", 8, 13), ("h", "scan", 14, 15)]))
    spans = rows("span_id long, id long, start_line int, end_line int", (1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 2, 3), (4, 2, 1, 1), (5, 2, 3, 4))
    got = {r["span_id"]: (r["issue"], [g["label"] for g in r["gaps"]] if r["gaps"] is not None else None) for r in search.read_lines(docs, spans, gaps).collect()}
    assert got == {1: (None, []), 2: (None, ["g"]), 3: (None, ["g", "h"]), 4: (None, None), 5: ("no such lines", None)}


def test_a_program_that_is_not_read_is_no_answer(rows):
    from quern.plans import evaluation

    fence = "`" * 3
    said = {
        "a": f"{fence}python\nprint(2 * 3)\n{fence}", "b": f"{fence}python\nif True:\n    x += 1\n{fence}", "c": f"[FINAL ANSWER]: 12 KZT\n{fence}python\nx = f'{{1}}'\n{fence}", "d": "[FINAL ANSWER]: 7", "e": None,
    }
    asked = rows("key string, condition string", *((k, "cot") for k in "abcdef"))
    got = evaluation.answered(asked, rows("key string, raw_response string", *said.items()))
    assert {r["key"]: (r["pred_value"], r["answer_state"]) for r in got.collect()} == {
        "a": ("6", "program"), "b": (None, "program not read"), "c": ("12", "program not read"), "d": ("7", "text"), "e": (None, "none"), "f": (None, "none"),
    }
    assert evaluation.unread_share(got).first()["not_read"] == pytest.approx(2 / 6, abs=1e-6)
