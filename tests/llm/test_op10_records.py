import zlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import framed_records as f
from quern.llm.common import scratch
from quern.llm.token_cache import ChunkEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ENCODERS = {}


@given(st.binary(max_size=300))
def test_frame_round_trip(payload):
    assert f.unframe(f.frame(payload)) == payload


@pytest.mark.parametrize("at", [0, 9, 13, -1])
def test_damage_is_seen(at):
    raw = bytearray(f.frame(b"some payload"))
    raw[at] ^= 1
    with pytest.raises(ValueError):
        f.unframe(bytes(raw))
    with pytest.raises(ValueError):
        f.unframe(f.frame(b"some payload")[:-3])


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aB é.,'s0 \n\t\r\x00漢😀ſI \x85|́"), max_size=40), min_size=1, max_size=6))
def test_chunked_tokens_equal_whole_ones(path, kind, texts):
    code = ENCODERS.setdefault(kind, ChunkEncoder(path, kind))
    assert code.encode_all(texts) == [code.whole(t) for t in texts]


def brute(rows):
    from tokenizers import Tokenizer

    code, out, start = Tokenizer.from_file(BYTE), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = code.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_round_trip_of_documents(spark, odd, documents):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(80))
    got = f.round_trip(spark, docs, BYTE, "byte", 0)
    got = got.select("doc_id", "start", (F.length("ids") / 4).cast("long"), F.crc32("ids")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute([tuple(r) for r in docs.collect()])))


def test_records_in_any_order_and_writing_again(spark, odd, documents):
    folder = scratch(spark, "test-records")
    index = f.write_ids(documents, folder, BYTE, "byte", 0, shards=3)
    some = index.filter("doc_id % 17 = 3").orderBy(F.rand(1))
    want = {r["doc_id"]: r["n_tokens"] for r in some.collect()}
    assert {r["doc_id"]: len(r["ids"]) // 4 for r in f.read_ids(some, folder).collect()} == want
    assert index.select("shard").distinct().count() <= 3
    wide = scratch(spark, "test-wide")
    rows = f.write_ids(odd, wide, BYTE, "byte", 1 << 20)  # an end id that needs four bytes
    read = f.read_ids(rows, wide).collect()
    assert len(read) == odd.count() and all(r["ids"][-4:] == (1 << 20).to_bytes(4, "little") for r in read)


def test_ids_that_do_not_fit_are_refused():
    assert f.packed((65535).to_bytes(4, "little"), 2) == b"\xff\xff"
    with pytest.raises(OverflowError):
        f.packed((65536).to_bytes(4, "little"), 2)


def test_many_rows_of_one_id_spread_over_shards(rows, spark):
    docs = rows("doc_id long, text string", *((7, f"{i} text") for i in range(400)), (1, "first"), (9, "last"))
    got = f.round_trip(spark, docs, BYTE, "byte", 0)
    assert got.select("shard").distinct().count() > 1
    got = got.select("doc_id", "start", (F.length("ids") / 4).cast("long"), F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == sorted(brute([tuple(r) for r in docs.collect()]))


def _thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_words_that_collide_in_any_polynomial_hash(path, kind, monkeypatch):
    from quern.llm import token_cache

    texts = [_thue_morse(n, flip) for n in (32, 64, 512, 1024, 2048, 8192) for flip in (0, 1)]
    texts.append(" ".join(_thue_morse(1024, i % 2) for i in range(6)))
    code = ChunkEncoder(path, kind)
    assert code.encode_all(texts) == [code.whole(t) for t in texts]
    monkeypatch.setattr(token_cache.Powers, "slices", lambda self, data, start, end: (end - start).astype("u8"))
    code = ChunkEncoder(path, kind)  # every word of one length has the same key
    texts = ["ab cd ab", "xy zw\nab q", "", "ab", " cd"]
    assert code.encode_all(texts) == [code.whole(t) for t in texts]


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_very_long_texts_and_words(path, kind):
    import random

    rng = random.Random(2)
    texts = ["x y " * 50000, "word\n" * 50000 + "end", "a" * 300000 + " b", "".join(rng.choice("abcdé漢.,") for _ in range(5000))]
    texts += [" ".join("".join(rng.choice("ab.,Σς") for _ in range(1 + rng.randrange(200))) for _ in range(3000))]
    code = ChunkEncoder(path, kind)
    assert code.encode_all(texts) == [code.whole(t) for t in texts]


def test_empty_table(spark, no_docs):
    assert f.round_trip(spark, no_docs, BYTE, "byte", 0).count() == 0


def test_idle_encoders_are_freed(monkeypatch):
    import time

    from quern.llm import token_cache

    monkeypatch.setattr(token_cache, "IDLE", 0.4)
    code = token_cache.encoder(BYTE, "byte")
    assert token_cache.encoder(BYTE, "byte") is code
    time.sleep(1.2)
    assert not token_cache._ENCODERS and token_cache.encoder(BYTE, "byte") is not code


def test_strings_of_special_tokens_are_read_as_the_library_reads_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm.token_cache import ChunkEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    texts = [f"{a}{t}{b}" for t in [*added, *map(str.upper, added), added[0][:-1]] for a, b in (("", ""), ("word ", " word"), ("x", "y"), ("1\n", "\n2"), (" ", "  "))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = ChunkEncoder(path, "byte").encode_all(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == want
