import re

import pytest
from pyspark.sql import functions as F

from quern.functions import calculator, prompts, temporal, text


def one(rows, f, *values):
    return rows("t string", *((v,) for v in values)).select(f(F.col("t")).alias("x")).collect()


def test_tokens(rows):
    (r,) = one(rows, text.tokens, "Abc ABCDEFG x 7 2024 税法条 a_b")
    assert r["x"] == ["abc", "abcdefg", "#abcde", "7", "2024", "税法条", "税法", "法条", "a_b"]
    assert one(rows, text.tokens, None, "")[1]["x"] == []


def test_years(rows):
    assert one(rows, text.years, "1959 1960 x1970 2029 2030 12025, 2005.")[0]["x"] == [1960, 2029, 2005]


@pytest.mark.parametrize(
    "said,value,unit",
    [
        ("so \\boxed{1} and \\boxed{500 000} KZT", "500000", "KZT"),
        ("x\n[FINAL ANSWER]: 1,234.50 USD", "1234.50", "USD"),
        ("\\boxed{Insufficient information}", "insufficient information", None),
        ("недостаточно информации", "insufficient information", None),
        ("first\nthe tax is 12.", "12", None),
        ("no number here", "no number here", None),
        ("\\boxed{0} percent", "0", "percent"),
        ("10 apples", "10", "apples"),
        ("", None, None),
    ],
)
def test_answer(rows, said, value, unit):
    r = one(rows, text.answer, said)[0]["x"]
    assert r["value"] == value and (unit is None or r["unit"] == unit)


@pytest.mark.parametrize(
    "pred,gold,exact,near",
    [("1000.00", "1000", 1, 1), ("1000.01", "1000", 1, 1), ("1000.02", "1000", 0, 1), ("1005", "1000", 0, 1), ("1011", "1000", 0, 0), (None, "1", 0, 0),
     ("Insufficient information", "insufficient information", 1, 1), ("insufficient information", "0", 0, 0), ("abc", " ABC", 1, 1), ("1e400", "1", 0, 0)],
)
def test_matches(rows, pred, gold, exact, near):
    r = rows("p string, g string", (pred, gold)).select(text.exact_match(F.col("p"), F.col("g")), text.tolerant_match(F.col("p"), F.col("g"))).first()
    assert tuple(r) == (bool(exact), bool(near))


def test_plain_decimals(rows):
    good, bad = ["1", "-1.5", "+.5", "1.", "0" * 5 + "1"], ["1,000", "1e3", "", ".", "1_0", "9" * 101, None]
    assert [r["x"] for r in one(rows, text.is_plain_decimal, *good, *bad)] == [True] * len(good) + [False] * len(bad)


def test_quotes_bind_to_the_source(rows):
    source = "Rate is \n10 percent (a+b). Rate is twelve."
    q = lambda quote: rows("q string, s string", (quote, source)).select(text.bind_quote(F.col("q"), F.col("s"))).first()[0]
    assert q("is 10 percent") == "is \n10 percent" and q("(a+b).") == "(a+b)."
    assert q("Rate  is") is None and q("is 11 percent") is None and q("10 percent twelve") is None


def test_small_functions(rows):
    assert one(rows, lambda t: text.duplicate_signature(t), "A 1,5\tb")[0]["x"] == one(rows, lambda t: text.duplicate_signature(t), "a 22 B")[0]["x"]
    assert one(rows, text.source_id, "raw/s_ab12.html", "plain") == [("s_ab12",), ("plain",)]
    assert one(rows, text.token_estimate, "", "é" * 1000)[1]["x"] == 1512
    assert one(rows, lambda t: text.omit(t, F.lit("b c")), "a b c d", "b c b c")[0]["x"] == "a d"
    assert one(rows, lambda t: text.render(t, F.lit(2024)), "in {case_year}")[0]["x"] == "in 2024"
    assert "[url]" in one(rows, text.redact, "see https://x.y/z?k=1")[0]["x"]
    assert one(rows, lambda t: text.error_category(t, F.lit(429)), "Nesting depth", "slow")[0]["x"] == "schema_complexity"
    assert one(rows, lambda t: text.file_name(t, F.lit("https://a.b/c/d%20e.pdf?x")), 'attachment; filename="a.pdf"', "", "filename=../x") == [("a.pdf",), ("d e.pdf",), (None,)]
    assert one(rows, lambda t: text.starts_formula(t), " =1+1", "a=b") == [(True,), (False,)]


@pytest.mark.parametrize(
    "given,value",
    [("0.1 + 0.2", "0.3"), ("round(2.675, 2)", "2.68"), ("round_half_even(2.665, 2)", "2.66"), ("round_down(-2.669, 2)", "-2.66"), ("round_half_up(1234, -2)", "1200"),
     ("1e3 / 4", "250"), ("min(3, 2) - max(1, 5) * abs(-2)", "-8"), ("floor(-1.5) + ceil(1.2)", "0"), ("2 ** 100000", None), ("1 / 0", None), ("1 % 2", None), ("1_000 + 1", None),
     ("0xff", None), ("round(1.25, 100)", None), ("", None), ("__import__('os')", None), ("(" * 60 + "1" + ")" * 60, "1"), ("-" * 60 + "1", None), ("1" * 4001, None), ("x", None)],
)
def test_calculator(given, value):
    assert calculator.calculate(given) == value


@pytest.mark.parametrize(
    "code,value",
    [("ans = 0", "0"), ("from decimal import Decimal\nrate = Decimal('0.1')\nresult = rate * 50", "5"), ("x = 2\nprint(x + 1)", "3"), ('ans = "insufficient information"', "insufficient information"),
     ("import os", None), ("while True: pass", None), ("ans = open('x')", None), ("answer = 1\nans = 2", "2"), ("", None)],
)
def test_programs(code, value):
    assert calculator.run_program(code) == value


def test_calculator_columns(rows):
    df = rows("e string, m array<string>", ("1+1", ["1", "2*3"]), (None, ["1", "x"]))
    r = df.select(calculator.calculate_udf("e"), calculator.calculate_many_udf("m")).collect()
    assert [tuple(x) for x in r] == [("2", ["1", "6"]), (None, None)]


@pytest.mark.parametrize(
    "y,case,weight",
    [((None, None, False, False), 2000, 0.6), ((2010, 2010, False, False), 2009, 0.05), ((2005, 2015, True, False), 2016, 0.1), ((2010, 2015, True, False), 2016, 2.5),
     ((2010, 2012, True, False), 2016, 2.0), ((2010, 2011, False, True), 2012, 2.4), ((2010, 2011, False, True), 2013, 0.1), ((2010, 2011, False, False), 2016, 1.5 / 1.4), ((2010, 2011, False, False), None, 1.0)],
)
def test_temporal_multiplier(rows, y, case, weight):
    df = rows("e int, s int, c boolean, b boolean, y int", (*y, case))
    got = df.select(temporal.multiplier(F.col("e"), F.col("s"), F.col("c"), F.col("b"), F.col("y"), F.array(F.lit(2005), F.lit(2010))).cast("double")).first()[0]
    assert got == pytest.approx(weight)


def test_temporal_metadata(rows):
    df = rows("id string, title string, raw_path string", ("a", "Налоговый кодекс 2017", "x/2020.html"), ("b", "Закон от 18 июля 2025", ""), ("c", "No year", "raw/1999/x"), ("d", "No year", None), ("e", "Finance Act 2019 amends 2010", None))
    got = {r["id"]: (r["y_eff"], r["y_snap"], r["is_code"], r["is_budget"]) for r in temporal.metadata(df).collect()}
    assert got == {"a": (2018, 2020, True, False), "b": (2026, 2025, False, False), "c": (1999, 1999, False, False), "d": (None, None, False, False), "e": (2010, 2019, False, True)}


def test_prompts(rows):
    df = rows("c string", ("oracle_cot",), ("bm25_rag_cot",), ("closed_book_program_cot",))
    cit = F.array(F.struct(F.lit("C1").alias("citation_id"), F.lit("T").alias("official_title"), F.lit("1").alias("article_section"), F.lit("gold").alias("supporting_passage")))
    pas = F.array(F.struct(F.lit(1).alias("rank"), F.lit("t").alias("title"), F.lit("found").alias("text")))
    a, b, c = (r[0] for r in df.select(prompts.prompt(F.col("c"), F.lit("KZ"), F.lit(2024), F.lit(" q "), cit, pas)).collect())
    assert "gold" in a and "found" not in a and "found" in b and "gold" not in b and "gold" not in c and "found" not in c
    assert "```python" in c and "\\boxed" in a and all("[QUESTION]:\nq\n" in x and "KZ in 2024" in x for x in (a, b, c))


def test_article_context(rows):
    t = "Статья 11. no\nСтатья 1. " + "x" * 60
    assert one(rows, lambda c: text.article_context(c, F.lit("1")), t)[0]["x"].startswith("Статья 1. x")
    assert one(rows, lambda c: text.article_context(c, F.lit("7")), t)[0]["x"] is None


def test_patterns_compile_in_python_too():
    assert re.compile(text.YEAR.replace(r"\p{L}\p{N}_", r"\w")).findall("1999 x2000")
