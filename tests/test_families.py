import pytest

from quern.operators import families as f

RUN = {"country": "KZ", "language": "ru", "currency": "KZT"}
STEPS = "array<struct<step:string,result:string,unit:string,citations:array<string>>>"
Q = f"family string, no int, country string, language string, variant string, case_year int, status string, note string, question string, unit string, answer_value string, gold_steps {STEPS}"
C = "family string, question_no int, language string, citation_id string, source_file string, supporting_passage string"
D = "id string, raw_path string, country string, language string, kind string, text string"
NAMES = [x.split()[0] for x in Q.replace(STEPS, "x").split(", ")]


def question(**change):
    base = dict(family="F1", no=1, country="KZ", language="ru", variant="original", case_year=2024, status="draft", note=None, question="How much?", unit="KZT", answer_value="10",
                gold_steps=[("s", "10", "KZT", ["C1"])])
    return tuple((base | change)[n] for n in NAMES)


def citation(**change):
    base = dict(family="F1", question_no=1, language="ru", citation_id="C1", source_file="s_1", supporting_passage="the tax is ten")
    return tuple((base | change).values())


def check(rows, questions, citations, assigned=((1,),)):
    documents = [("s_1", "raw/1", "KZ", "ru", "law", "Here the tax is ten percent. [UNAVAILABLE PROVISION: Art. 5] end"), ("s_2", "raw/2", "PL", "pl", "law", "the tax is ten"), ("s_3", "raw/3", "KZ", "ru", "navigation", "the tax is ten"),
                 ("s_4", "raw/4", "KZ", "ru", "law", "x"), ("s_5", "raw/4", "KZ", "ru", "law", "y")]
    out = f.family_failures(
        rows("family string, no int", *(("F1", *a) for a in assigned)), rows(Q, *questions), rows(C, *citations), rows(D, *documents), rows("label string, start int, end int", ("new", 2020, 2030)), RUN,
    )
    return sorted((r["no"] or 0, r["failure"]) for r in out.collect())


def test_a_sound_family_has_no_failure(rows):
    assert check(rows, [question()], [citation()]) == []


@pytest.mark.parametrize(
    "change,want",
    [
        ({"question": " =A1"}, [(1, "formula")]),
        ({"country": "PL"}, [(1, "other assignment")]),
        ({"status": "validated"}, [(1, "validated by its author")]),
        ({"variant": "numbers"}, [(0, "originals"), (1, "no note")]),
        ({"case_year": 1999}, [(1, "no period")]),
        ({"unit": "GBP", "gold_steps": [("s", "10", "GBP", ["C1"])]}, [(1, "unit")]),
        ({"gold_steps": [("s", "11", "KZT", ["C1"])]}, [(1, "last step")]),
        ({"gold_steps": [("s", "10", "KZT", ["C1", "C9"])]}, [(1, "step cites what is missing")]),
        ({"no": 2}, [(0, "assigned numbers"), (1, "citation of no question"), (2, "no citation"), (2, "step cites what is missing")]),
    ],
)
def test_questions(rows, change, want):
    assert check(rows, [question(**change)], [citation()]) == want


def test_a_family_that_was_not_assigned_is_told(rows):
    got = check(rows, [question(), question(family="F2")], [citation(), citation(family="F2")])
    assert (1, "other assignment") in got and (0, "assigned numbers") in got


@pytest.mark.parametrize(
    "change,want",
    [
        ({"source_file": "s_9"}, "no single source"),
        ({"source_file": "raw/4"}, "no single source"),
        ({"source_file": "s_2"}, "source of another country or language"),
        ({"source_file": "s_3"}, "navigation page"),
        ({"supporting_passage": "is not there"}, "quote"),
        ({"supporting_passage": "[UNAVAILABLE PROVISION: Art. 5]"}, "unavailable provision"),
    ],
)
def test_citations(rows, change, want):
    assert check(rows, [question()], [citation(**change)]) == [(1, want)]


def test_whole_families(rows):
    twin = question(no=2, variant="numbers", note="n", question="How much? ", answer_value="10")
    got = check(rows, [question(), twin], [citation(), citation(), citation(question_no=2)], ((1,), (2,)))
    assert got == [(1, "citation twice"), (2, "differs by numbers only")]
    assert (0, "number twice") in check(rows, [question(), question()], [citation()])


def test_runs(rows):
    q = "family string, no int, variant string, case_year int, year_period_target string, tax_category string, question string, derived_from int"
    questions = rows(q, ("F", 1, "original", 2024, "new", "1000", "In 2024?", None), ("F", 2, "temporal", 2019, "new", "1000", "In 2019!", 1), ("F", 4, "numbers", 2024, "new", "2000", "x", None), ("G", 1, "missing_information", 2024, "new", "3000", "y", None))
    slots = rows("family string, no int, label string, start int, end int", ("F", 1, "new", 2020, 2030), ("F", 2, "new", 2020, 2030), ("F", 3, "new", 2020, 2030), ("G", 1, "new", 2020, 2030))
    families = rows("family string, category string, options array<string>, reallocation string", ("F", "1000", ["1000", "2000"], None), ("G", "1000", None, None))
    templates = rows("family string, no int, template string", ("F", 1, "In {case_year}?"), ("F", 4, "no year"))
    got = sorted((r["family"], r["no"] or 0, r["failure"]) for r in f.run_failures(questions, slots, families, templates, ["1000", "2000"]).collect())
    assert got == [
        ("F", 0, "one enabled category"), ("F", 2, "counterpart changed"), ("F", 2, "other slot"), ("F", 3, "not the assigned cases"), ("F", 4, "not the assigned cases"), ("F", 4, "template without year"),
        ("F", 4, "text is not its template"), ("G", 0, "breaks temporal balance"), ("G", 0, "category without reason"), ("G", 0, "one enabled category"), ("G", 1, "not the assigned cases"),
    ]


def test_small_reports(rows):
    docs = rows("id string, kind string, title string", ("a", "law", "A"), ("b", "navigation", "B"), ("c", None, "C"))
    summary = f.inventory_summary(docs)
    assert summary.columns == f.SUMMARY and {r["id"] for r in summary.collect()} == {"a", "c"}
    topics = rows("tax_category string", ("1000",), ("1000",), ("9000",))
    assert sorted(map(tuple, f.topic_counts(topics, ["1000", "2000"]).collect())) == [("1000", 2), ("2000", 0)]
    assigned = rows("family string, category string, regular array<int>, missing array<int>", ("F", "1000", [1, 2], [3]), ("G", "1000", [4], []))
    slots = rows("family string, label string", ("F", "new"), ("F", "old"), ("G", "new"))
    assert [tuple(r) for r in f.settings_preview(assigned, slots).collect()] == [("1000", 2, 3, 1, {"new": 2, "old": 1})]
    both = f.united(rows("no int, a string", (1, "x")), rows("no int, b string", (2, "y")))
    assert sorted(map(tuple, both.collect())) == [(1, "x", None), (2, None, "y")]
    cited = rows("official_source_url string", ("u1",), ("u2",))
    assert sorted((r[0], r["translated_text"], r["issue"]) for r in f.translated(cited, rows("url string, text string", ("u1", "t"))).collect()) == [("u1", "t", None), ("u2", None, "no translation")]
