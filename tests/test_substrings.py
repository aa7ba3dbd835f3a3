import random
import re

import duckdb
import pytest

from quern import contract_queries
from quern.operators import alignment, substrings
from tests.test_alignment import CITED, DOCS

SIGNS = ["a", "b", "ab", "ba", "é", "漢", "\U0001f468", "é", "_", "7", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", ".", ", ", "("]


def some(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(n))


def odd_tables(rng, folder, texts, items):
    docs = [None, "", " ", "\n", *(some(rng, rng.randrange(1, 200)) for _ in range(texts))]
    quotes = [None, "", " ", "\xa0", "\n a", "a\n", ".", "a"]
    for _ in range(items):
        t = rng.choice(docs[4:])
        at = rng.randrange(len(t))
        q = t[at : at + rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 40])]
        quotes.append(rng.choice([q, q, q + some(rng, 3), q.replace(" ", "\n"), q * 2]))
    docs += [f"x{t} {t}{some(rng, 4)}" for t in quotes if t]
    con = duckdb.connect()
    for name, key, values in (("documents", "doc_id", docs), ("benchmark", "item_id", quotes)):
        (folder / name).mkdir(parents=True)
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        # the last rows' ids come twice
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [(min(i, len(values) - 2) if i else None, t) for i, t in enumerate(values)])
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("rows", [50_000, 40])
def test_query_equals_its_sql_on_odd_texts(spark, tmp_path, monkeypatch, rows):
    """Quotes within words, without words, with white space at their ends, null; in one part and in several."""
    monkeypatch.setattr(substrings, "ROWS", rows)
    con = odd_tables(random.Random(5), tmp_path, 120, 160)
    want = con.execute(contract_queries.SQL["citation_alignment"]).fetchall()
    got = [tuple(r) for r in contract_queries.citation_alignment(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"exact", "spaces", "prefix"}


def test_a_word_that_goes_on_counts(rows):
    """The first words once as such and once as the beginning of other words are no single place; a quote may end within a word."""
    docs = rows("id int, text string", (1, "Ly was st the end. Ly was st thent."), (2, "xLy was st thent."), (3, "Ly  was\nst the, on"))
    cited = rows("citation_id int, id int, article string, quote string", (1, None, None, "Ly was st the other"), (2, None, None, "Ly was st the"), (3, 2, None, "Ly was st the"), (4, 1, None, "."))
    got = {(r.citation_id, r.id): (r.rung, r.start, r.passage) for r in alignment.aligned(cited, docs, whole=False).collect()}
    assert got == {(1, 2): ("prefix", 1, "Ly was st thent."), (2, 1): ("exact", 0, "Ly was st the"), (2, 2): ("exact", 1, "Ly was st the"), (2, 3): ("spaces", 0, "Ly  was\nst the"), (3, 2): ("exact", 1, "Ly was st the"), (4, 1): ("exact", 17, ".")}


def test_whole_words_are_found_as_parts_too(rows):
    tables = rows("citation_id int, id string, article string, quote string", *CITED), rows("id string, text string", *DOCS)
    got = {(r.citation_id, r.id): r.rung for r in alignment.aligned(*tables, whole=False).collect()}
    assert got[1, "a"] == got[18, "a"] == got[19, "a"] == "exact" and got[5, "a"] == "prefix" and got[6, "a"] == "article" and got[7, "a"] is None


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_pieces_of_long_texts(monkeypatch, step):
    monkeypatch.setattr(substrings, "STEP", step)
    rng = random.Random(step)
    text = some(rng, 600)
    quotes = sorted({text[i : i + n] for i in range(0, len(text) - 40, 7) for n in (1, 3, 16, 33)} | {some(rng, 5) for _ in range(200)})
    flat = re.sub(substrings.WHITE, " ", text)
    got = {quotes[row]: (rung, start) for row, rung, start, _ in substrings.found(text, substrings.indexed(quotes), 80) if rung != "prefix"}
    want = {q: ("exact", text.find(q)) for q in quotes if q in text}
    alone = [q for q in quotes if q not in want and flat.count(re.sub(substrings.WHITE, " ", q)) == 1]
    assert {q: x for q, x in got.items() if x[0] == "exact"} == want and sorted(q for q, x in got.items() if x[0] == "spaces") == sorted(alone)


def test_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(substrings, "_hashes", lambda codes: ((k, codes[: len(codes) - k + 1] * 0 + 0 * k) for k in (1, 2, 4, 8, 16) if k <= len(codes)))
    levels = {k: v._replace(shift=0) for k, v in substrings.indexed(["one two", "two three", "four"]).items()}
    assert [x[:3] for x in substrings.found("one two  three", levels, 80)] == [(0, "exact", 0), (1, "spaces", 4)]
