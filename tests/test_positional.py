import re

import pytest

from quern.operators import positional as p
from quern.operators import search

TEXT = {
    1: "The land tax\r\nis due.\n35 percent of 1,000.50 tenge\n\nLand\ntax payers",
    2: "no such words",
    3: "tax on land and land tax; 357 or 1,000,500\nincome-tax TAXES",
    4: None,
    5: "",
    6: "x" * 1500 + " land " + "y" * 1300 + " tax " + "z" * 900,
    7: "a\n" * 30 + "land\nof\ntax\n" + "b\n" * 3,
    8: "😀😀 land 😀 tax next line\x85last",
}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(TEXT.items()), "id long, text string")


QUERIES = ["land tax", "35", "tax*", "1,000", "000.50", "ПОДОХОД* налог*", "TAX land", "land*tax", "", "tenge 35", "percent of 1,000.50", "income tax"]


def brute(query):
    """Ranks of lines by patterns over the lines of each text."""
    try:
        patterns = [re.compile(rf"(?i)(?<!\w){re.escape(t.rstrip('*'))}{'[^\\W\\d_]*' if t.endswith('*') else ''}(?!\w)") for t in p.terms_of(query)]
    except ValueError:
        return {}
    out = {}
    for i, text in TEXT.items():
        rows = re.findall(r"[^\r\n\x85 ]*(?:\r\n|[\r\n\x85 ])|[^\r\n\x85 ]+$", text or "")
        for n, line in enumerate(rows):
            three = "".join(rows[n : n + 3])
            if patterns and all(x.search(line) for x in patterns):
                out[i, n + 1] = 0 if query.strip().lower() in line.lower() else 1
            elif patterns and all(x.search(three) for x in patterns):
                out[i, n + 1] = 2
    return out


def test_search_of_many_queries_against_brute_force(spark, docs):
    runs, cut = p.index(docs)
    got = p.search(runs, cut, spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")).collect()
    assert len(got) == len({(r["query_id"], r["id"], r["line_no"]) for r in got})
    for q, query in enumerate(QUERIES):
        want = {k: v for k, v in brute(query).items() if k[0] != 6}  # the excerpt of 6 can't hold both words
        assert {(r["id"], r["line_no"]): r["rank"] for r in got if r["query_id"] == q and r["id"] != 6} == want, query
    for r in got:
        assert TEXT[r["id"]][r["start"] : r["end"]] == r["excerpt"] and len(r["excerpt"]) <= p.EXCERPT
        lines = p._END.split(TEXT[r["id"]])
        assert 1 <= r["start_line"] <= r["line_no"] <= r["last_line"] <= len(lines)


@pytest.mark.parametrize("query", ["land tax", "tax*", "1,000"])
def test_a_scan_finds_the_same(spark, docs, query):
    runs, cut = p.index(docs)
    a = p.search(runs, cut, spark.createDataFrame([(0, query)], "query_id int, query string")).drop("query_id").orderBy("id", "line_no").collect()
    b = search.find(docs, query).orderBy("id", "line_no").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and a


@pytest.mark.parametrize("query", QUERIES)
def test_hits_are_told_whatever_their_excerpt_would_hold(docs, query):
    try:
        got = search.hits(docs, query).collect()
    except ValueError:
        got = []
    assert {(r["id"], r["line_no"]): r["rank"] for r in got} == brute(query)
    if query == "land tax":
        assert (6, 1, 1) in {tuple(r) for r in got} and 6 not in {r["id"] for r in search.find(docs, query).collect()}


def test_long_lines_are_cut_round_the_match(spark):
    text = "u" * 3000 + " land tax " + "v" * 3000
    got = search.find(spark.createDataFrame([(1, text)], "id long, text string"), "land tax").first()
    assert (got["start"], got["end"]) == (2901, 4101) and "land tax" in got["excerpt"]


def test_only_folders_of_the_terms_are_read(spark, docs):
    runs, cut = p.index(docs)
    assert {"folder=" in f for f in runs.inputFiles()} == {True}
    plan = runs.filter(runs["folder"].isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan


def test_the_index_has_a_row_for_each_term_of_a_document(spark):
    runs, _ = p.index(spark.createDataFrame([(1, "a b a\nA 1,0 a 1")], "id long, text string"))
    got = {r["term"]: (r["line_no"], r["place"], r["gap"]) for r in runs.collect()}
    assert runs.count() == 4 and got == {"a": ([1, 2], [], ""), "b": ([1], [], ""), "1": ([2, 2], [1, 4], "  "), "0": ([2], [2], ",")}


def test_empty_index(spark, docs):
    runs, cut = p.index(docs.limit(0))
    assert p.search(runs, cut, spark.createDataFrame([(1, "land")], "query_id int, query string")).count() == 0
