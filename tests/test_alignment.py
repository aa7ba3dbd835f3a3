import pytest

from quern.operators import alignment, offsets

LAW = (
    "General part, before any article of this law begins.\n"
    "Article 1. Rates\nThe rate of the tax is ten per cent of the income of a person.\nIt is (paid once) a year, «by March» at the latest.\n"
    "Article 2. Relief\nA person who is over sixty pays half the rate  of\tthe tax, as Article 1 has it.\nThe rate of the tax is ten per cent of the income of a person.\n"
    "Short line.\nNo relief is given to those who reside in other countries for a year.\n"
    "3-бап. Мерзім\nСалық жыл сайын наурыз айының соңына дейін төленеді, бұл міндетті.\n"
)
DOCS = [("a", LAW), ("b", LAW.replace("ten per cent", "a fifth")), ("c", None), ("d", ""), ("e", "x" * 5000 + " one two three four five six " + "y" * 5000)]
CITED = [
    (1, "a", "2", "over sixty pays half"),
    (2, "a", "1", "(paid once) a year, «by March»"),
    (3, "a", "2", " half the rate of the tax, as Article 1 "),  # white space differs
    (4, "a", "1", "The rate of the tax is ten per cent of the income of a person."),  # twice: the first place
    (5, "a", "9", "who is over sixty owes nothing"),  # its first four words only
    (6, "a", "1 and 2", "entirely other words"),  # the last number's article
    (7, "a", "7", "entirely other words"), (8, "c", "1", "any"), (9, "d", "1", None), (10, "zz", "1", "over sixty pays half"), (11, "a", None, "..."),
    (12, None, None, "General part, before"), (13, None, None, "ten per cent"), (14, None, None, "nowhere to be found at all"),
    (15, "a", "3", "the rate of the tax is other here"),  # its first words, as written, stand nowhere
    (16, "e", "1", "one two three four five six"), (17, "e", "1", "two three four five other"),
    (18, "a", "1", "sixty pays"), (19, "a", "1", "ixty pays"),
]


@pytest.fixture
def tables(rows):
    return rows("citation_id int, id string, article string, quote string", *CITED), rows("id string, text string", *DOCS)


@pytest.mark.parametrize("most", [300_000, 2])
def test_rungs(tables, monkeypatch, most):
    """With few quotes and with more than are sent to the tasks."""
    monkeypatch.setattr(alignment, "BLOCK", 32)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", most)
    got = {(r.citation_id, r.id): (r.rung, r.start, r.passage) for r in alignment.aligned(*tables).collect()}
    text = dict(DOCS)
    for (_, i), (rung, start, passage) in got.items():
        if rung:
            assert text[i][start : start + len(passage)] == passage
    assert {k: v[0] for k, v in got.items()} == {
        (1, "a"): "exact", (2, "a"): "exact", (3, "a"): "spaces", (4, "a"): "exact", (5, "a"): "prefix", (6, "a"): "article", (7, "a"): None, (8, "c"): None, (9, "d"): None,
        (10, "zz"): None, (11, "a"): None, (12, "a"): "exact", (12, "b"): "exact", (13, "a"): "exact", (15, "a"): "article", (16, "e"): "exact", (17, "e"): "prefix", (18, "a"): "exact", (19, "a"): "article",
    }
    assert got[4, "a"][1] == LAW.index("The rate")
    assert got[3, "a"][2] == "half the rate  of\tthe tax, as Article 1"
    assert got[5, "a"][2].startswith("who is over sixty pays half") and len(got[5, "a"][2]) <= 30 + 80
    assert got[6, "a"][2] == "A person who is over sixty pays half the rate  of\tthe tax, as Article 1 has it."
    assert got[15, "a"][2].startswith("Салық")
    assert got[19, "a"][2] == "It is (paid once) a year, «by March» at the latest."  # the line before it stands twice
    assert got[17, "e"][2].startswith("two three four five six")


def test_contexts_by_heading_and_by_mention(rows, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 64)
    docs = rows("id string, text string", ("a", LAW), ("m", "Start.\nArticle 4. On this\nThe rules of Article 8 and of 12-бап are kept, also for others.\nArticle 5. On that\nand more\n"))
    asked = rows("citation_id int, id string, article string", (1, "a", "2"), (2, "a", "art. 3"), (3, "m", "8"), (4, "m", "99, 12"), (5, "m", "5"), (6, "m", "1"), (7, "m", "4 and 99"), (8, "m", ""))
    got = {r.citation_id: (r.number, r.found, r.piece) for r in alignment.contexts(asked, docs).collect()}
    assert got == {1: ("2", "heading", 2), 2: ("3", "heading", 3), 3: ("8", "mention", 1), 4: ("12", "mention", 1), 5: ("5", "mention", 2), 7: ("4", "heading", 1)}


def test_empty_tables(rows):
    cited, docs = rows("citation_id int, id string, article string, quote string"), rows("id string, text string")
    assert alignment.aligned(cited, docs).count() == 0
    assert alignment.aligned(cited, rows("id string, text string", *DOCS)).count() == 0
