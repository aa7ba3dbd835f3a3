from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import pack_histogram as p
from quern.llm.common import stored


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    packs = p.patterns(histogram, 64)
    seen = Counter()
    for pattern, count in packs:
        assert sum(n * t for n, t in pattern) <= 64 and count > 0
        for n, t in pattern:
            seen[n] += t * count
    assert seen == Counter(histogram)
    ranges = {}
    for n, lo, hi, *_ in p.rank_ranges(packs):
        assert ranges.get(n, 0) == lo < hi
        ranges[n] = hi
    assert ranges == histogram


def test_shortest_pack_first():
    assert p.patterns({6: 1, 5: 1, 4: 1, 3: 1}, 10) == [(((6, 1), (3, 1)), 1), (((5, 1), (4, 1)), 1)]
    with pytest.raises(ValueError):
        p.patterns({11: 1}, 10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_patterns_equal_placing_one_by_one(lengths):
    """Longest first, each into the shortest pack that has room, else a new one."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= 32]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    got = Counter()
    for pattern, count in p.patterns(Counter(lengths), 32):
        got[sum(n * t for n, t in pattern)] += count
    assert got == Counter(map(sum, packs)) and sum(got.values()) == len(packs)


def placed(docs, capacity):
    cut = p.pieces(docs, P.path("word_bpe_49k.json"), "word", 1, capacity)
    return p.pack(stored(cut, "test-pieces"), ["doc_id", "start", "ids"], capacity)


def test_each_id_lies_in_one_piece_and_sequences_have_no_gap(odd, documents):
    from tokenizers import Tokenizer

    docs = odd.select("doc_id", "text").filter("doc_id is not null").union(documents.select((F.col("doc_id") + 100).alias("doc_id"), "text").limit(50))
    got = placed(docs, 128).toPandas()
    code = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = Counter((r["doc_id"], tuple(code.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect())
    want = Counter()
    for (d, ids), n in whole.items():
        for s in range(0, len(ids), 128):
            own = ids[s : s + 128]
            want[d, s, len(own), len(ids), b"".join(i.to_bytes(4, "little") for i in own)] += n
    assert Counter(zip(got.doc_id, got.start, got.length, got.doc_tokens, got.ids.map(bytes))) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 128
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1


def test_sequences_put_together(odd):
    rows = placed(odd, 2048)
    whole = p.sequences(rows).collect()
    assert sum(r["n_tokens"] for r in whole) == rows.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in whole)


def test_empty_table(no_docs):
    assert placed(no_docs, 2048).count() == 0


def test_little_padding(documents):
    got = placed(documents, 2048).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert got[0] / (2048 * got[1]) > 0.97


def test_strings_of_special_tokens_are_read_as_the_library_reads_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm.token_cache import ChunkEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    texts = [f"{a}{t}{b}" for t in [*added, *map(str.upper, added), added[0][:-1]] for a, b in (("", ""), ("word ", " word"), ("x", "y"), ("1\n", "\n2"), (" ", "  "))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = ChunkEncoder(path, "word").encode_all(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == want
