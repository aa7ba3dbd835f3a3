import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import jpeg_media as j


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=5))
def test_bytes_round_trip(parts):
    payloads = [p + b"\xff" * (-len(p) % j.ROW) for p in parts]
    assert [t.tobytes() for t, _, _ in j.decode(j.encode(payloads))] == payloads


def test_many_rows_become_many_images(monkeypatch):
    monkeypatch.setattr(j, "MAX_ROWS", 3)
    payload = bytes(range(256)) * 6 + b" " * (-256 * 6 % j.ROW)
    (media,) = j.encode([payload])
    assert len(j.parse(media)) == -(-len(payload) // j.ROW // 3) and j.decode([media])[0][0].tobytes() == payload


class Writer:
    """A plain bit-by-bit encoder for images with other coefficients, sampling and no restarts."""

    DC, AC = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 2, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    DC_SYMBOLS, AC_SYMBOLS = tuple(range(12)), (0x00, 0x01, 0x11, 0xF0, 0x52, 0x23)

    def __init__(self):
        self.bits = ""
        self.dc, self.ac = j.canonical_codes(self.DC, self.DC_SYMBOLS), j.canonical_codes(self.AC, self.AC_SYMBOLS)

    def put(self, code, n):
        self.bits += format(code, f"0{n}b") if n else ""

    def block(self, diff, coefficients):
        size = abs(diff).bit_length()
        self.put(*self.dc[size])
        self.put(diff if diff > 0 else diff + (1 << size) - 1, size)
        for symbol, value in coefficients:
            self.put(*self.ac[symbol])
            self.put(value, symbol & 15)

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def image(components, scan, w, h, data, restart=0):
    def seg(m, body):
        return struct.pack(">BBH", 0xFF, m, len(body) + 2) + body

    sof = struct.pack(">BHHB", 8, h, w, len(components)) + b"".join(bytes([i + 1, hv, 0]) for i, hv in enumerate(components))
    sos = bytes([len(scan)]) + b"".join(bytes([i + 1, 0]) for i in scan) + bytes([0, 63, 0])
    tables = seg(0xC4, bytes([0, *Writer.DC, *Writer.DC_SYMBOLS, 0x10, *Writer.AC, *Writer.AC_SYMBOLS]))
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, sof) + tables + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, sos) + data + b"\xff\xd9"


def test_colour_image_with_sampling_and_coefficients():
    rng = np.random.default_rng(5)
    dc = rng.integers(-30, 30, (4, 4))  # luminance blocks of a 32 x 32 image, 4:2:0
    w, last = Writer(), [0, 0, 0]
    some = [[(0x00, 0)], [(0x01, 1), (0x11, 0), (0x00, 0)], [(0xF0, 0), (0x52, 2), (0x00, 0)], [(0x23, 5), (0x01, 0), (0x00, 0)]]
    for my in range(2):
        for mx in range(2):
            for v in range(2):
                for x in range(2):
                    value = int(dc[2 * my + v, 2 * mx + x])
                    w.block(value - last[0], some[(my + mx + v + x) % 4])
                    last[0] = value
            for c in (1, 2):
                w.block(7 * c - last[c], some[c])
                last[c] = 7 * c
    ((thumb, width, height),) = j.decode([image([0x22, 0x11, 0x11], [0, 1, 2], 32, 32, w.data())])
    assert (width, height) == (32, 32)
    assert (thumb == np.clip((dc * 16 + 4 >> 3) + 128, 0, 255)).all()


def test_grey_image_whose_size_is_no_multiple_of_eight():
    w, values = Writer(), [5, -3, 9, 0, 2, 1]
    for a, b in zip([0, *values], values):
        w.block(b - a, [(0x00, 0)])
    ((thumb, width, height),) = j.decode([image([0x11], [0], 20, 9, w.data())])
    assert (thumb.shape, width, height) == ((2, 3), 20, 9)


def test_bad_images():
    good = j.encode([b" " * j.ROW])[0]
    for bad in (good.replace(b"\xff\xc0", b"\xff\xc2"), b"nonsense", good[:-40] + good[-2:]):
        with pytest.raises((ValueError, IndexError)):
            j.decode([bad])


def test_query_rows(odd, no_docs):
    got = j.described(j.store(odd)).collect()
    want = []
    for d, t in odd.select("doc_id", "text").collect():
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append(str((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert j.described(j.store(no_docs)).count() == 0


def test_gradient_hash_is_of_the_picture():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (40, 1))
    assert j.gradient_hash(ramp) == "f" * 16 and j.gradient_hash(ramp[:, ::-1]) == "0" * 16


def plain_media(payload):
    """The image of one payload, bit by bit: a row of 192 blocks is a restart interval."""
    dc = j.canonical_codes(j.DC_LENGTHS, j.DC_SYMBOLS)
    out = []
    for at in range(0, len(payload), 192):
        bits, last = "", 128
        for x in payload[at : at + 192]:
            d, last = x - last, x
            code, n = dc[abs(d).bit_length()]
            bits += format(code, f"0{n}b") + (format(d if d > 0 else d + (1 << abs(d).bit_length()) - 1, f"0{abs(d).bit_length()}b") if d else "") + "0"
        bits += "1" * (-len(bits) % 8)
        out.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00"))
    body = b"".join(x + bytes([255, 0xD0 + i % 8]) for i, x in enumerate(out))[:-2]
    return j._head(len(payload) // 192) + body + b"\xff\xd9"


def plain_feature(payload):
    rows = len(payload) // 192
    grid = []
    for y in range(8):
        a = y * rows // 8
        b = max((y + 1) * rows // 8 if y < 7 else rows, a + 1)
        line = []
        for x in range(9):
            c, d = x * 192 // 9, (x + 1) * 192 // 9
            line.append(sum(sum(payload[192 * r + c : 192 * r + d]) for r in range(a, b)) / ((b - a) * (d - c)))
        grid.append(line)
    bits = "".join("1" if l < r else "0" for line in grid for l, r in zip(line, line[1:]))
    return f"{int(bits, 2):016x}"


def test_media_and_feature_equal_brute_force(documents, odd):
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(30)).filter("length(text) < 20000 or text is null")
    want = []
    for d, t in docs.collect():
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        m = plain_media(p)
        want.append(str((d, len(m), hashlib.sha256(m).hexdigest(), plain_feature(p))))
    for got in (j.described(j.store(docs)), j.round_trip(docs)):
        assert sorted(str(tuple(r)) for r in got.select("doc_id", "media_bytes", "media_sha256", "feature").collect()) == sorted(want)


def test_round_trip_stores_and_cleans_up(spark, documents, no_docs):
    import glob

    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert j.round_trip(documents).count() == documents.count() and j.round_trip(no_docs).count() == 0
    assert not glob.glob(f"{base}/media-[0-9a-f]*/*.parquet")


def test_a_very_long_text_is_many_images():
    payload = bytes(range(256)) * 12 * (j.MAX_ROWS // 16 + 5)
    payload = payload[: len(payload) // j.ROW * j.ROW]
    whole = j.encode([payload])[0]
    step = j.ROW * j.MAX_ROWS
    assert whole == b"".join(j.encode([payload[i : i + step]])[0] for i in range(0, len(payload), step))
    assert j.decode([whole, j.encode([b"x" * j.ROW])[0]])[0][0].tobytes() == payload
