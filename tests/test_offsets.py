import random

import pytest
from pyspark.sql import functions as F

from quern.operators import chunks, offsets, search


def brute(size, edits):
    """(out_at, edited) of each place of a text of `size` characters under (start, end, new) in order."""
    out, shift, at = {}, 0, 0
    for start, end, new in sorted(edits):
        for x in range(at, start):
            out[x] = (x + shift, False)
        for x in range(start, end):
            out[x] = (start + shift, True)
        shift, at = shift + len(new) - (end - start), end
    for x in range(at, size + 1):
        out[x] = (x + shift, False)
    return out


def test_every_place_there_and_back(spark, rows, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 16)  # many blocks, also such that a piece ends at their border
    random.seed(4)
    texts, edits, want = [], [], {}
    for i in range(40):
        size = random.choice([0, 1, 15, 16, 17, 32, 64, 90])
        cuts, own = sorted(random.sample(range(size + 1), min(size + 1, random.choice([0, 2, 4, 8])))), []
        for a, b in zip(cuts[::2], cuts[1::2]):
            own.append((a, b, "x" * random.choice([0, 1, 3, b - a, 20])))
        texts.append((i, size))
        edits += [(i, *e) for e in own]
        want[i] = brute(size, own)
    pieces = offsets.interval_map(rows("id long, size int", *texts), rows("id long, start int, end int, new string", *edits))
    points = rows("id long, at long, p string", *((i, x, "kept") for i, size in texts for x in [*range(-1, size + 2)]))
    there = offsets.to_output(pieces, points)
    got = {(r.id, r.at): (r.out_at, r.edited) for r in there.collect()}
    for i, size in texts:
        assert {x: got[i, x] for x in range(size + 1)} == want[i]
        assert got[i, -1] == got[i, size + 1] == (None, None)
    back = offsets.to_source(pieces, there.filter("out_at is not null").withColumnRenamed("edited", "was"), "out_at").collect()
    begin = {(i, x): max(a for j, a, b, _ in edits if j == i and a <= x < b) for i, size in texts for x, (_, e) in want[i].items() if e}
    deleted = {(i, a) for i, a, b, new in edits if not new}
    for r in back:
        assert r.p == "kept"
        if not r.was:
            assert r.source_at == r.at
        elif (r.id, begin[r.id, r.at]) not in deleted:  # the place of a deletion is that of what follows it
            assert r.source_at == begin[r.id, r.at]


def test_wrong_and_overlapping_edits_are_left_out(rows):
    sizes = rows("id long, size int", (1, 10), (2, 5), (3, 0))
    edits = rows("id long, start int, end int, new string", (1, 2, 5, "ab"), (1, 4, 6, "never"), (1, 6, 7, None), (1, 8, 11, "x"), (1, -1, 0, "x"), (1, 6, 5, "x"), (1, None, 5, "x"), (9, 0, 1, "x"), (3, 0, 0, "new"))
    got = [tuple(r) for r in offsets.interval_map(sizes, edits).orderBy("id", "piece").collect()]
    assert got == [
        (1, 1, 0, 2, 0, 2, False), (1, 2, 2, 5, 2, 4, True), (1, 3, 5, 6, 4, 5, False), (1, 4, 6, 7, 5, 5, True), (1, 5, 7, 10, 5, 8, False),
        (2, 1, 0, 5, 0, 5, False),
        (3, 1, 0, 0, 0, 3, True), (3, 2, 0, 0, 3, 3, False),
    ]
    assert offsets.interval_map(rows("id long, size int"), edits).count() == 0


@pytest.fixture
def laws(rows):
    one = "Intro\nArticle 1. One\nbody\nArticle 2. Two\n[GAP 3] lost\nmore\nArticle 3. Three\nend\n"
    return rows("id string, text string", ("a", one), ("b", "no heading [GAP]\n"), ("c", None), ("d", ""), ("e", one.replace("end", "[GAP] end")))


def test_gaps_keep_their_places(laws):
    got = {r.id: r for r in offsets.withheld_with_gaps(laws).collect()}
    plain = {r.id: r.text for r in chunks.withheld(laws).collect()}
    assert {i: r.text for i, r in got.items()} == plain
    for i, labels in {"a": ["Article 2. Two"], "b": [], "c": [], "d": [], "e": ["Article 2. Two", "Article 3. Three"]}.items():
        assert [g.label for g in got[i].gaps] == labels
        for g in got[i].gaps:
            assert got[i].text[g.start : g.end] == f"[UNAVAILABLE PROVISION: {g.label}]\n"
    assert got["b"].gap_outside_section


def test_line_reads_of_withheld_texts_tell_the_gaps(laws, rows):
    held = offsets.withheld_with_gaps(laws).filter("id = 'a'")
    spans = rows("span_id int, id string, start_line int, end_line int", (1, "a", 1, 3), (2, "a", 3, 4), (3, "a", 5, 6))
    got = {r.span_id: [g.label for g in r.gaps] for r in search.read_lines(held, spans, held).collect()}
    assert got == {1: [], 2: ["Article 2. Two"], 3: []}
