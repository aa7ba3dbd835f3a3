"""Baseline JPEG media columns: marker parsing, Huffman decoding of scans and DC-only luminance thumbnails in numpy.

`decode` reads baseline images (SOF0, 8-bit samples, Huffman coding, any sampling factors, one interleaved or
several scans, restart intervals): it parses the markers, decodes every block's symbols and keeps each block's DC
coefficient, so the thumbnail has one sample for each 8 x 8 block.  Restart intervals, of one image or of many
images with equal tables, are decoded in lock step, one numpy operation for all.

`encode` stores bytes as such images without loss: one byte is the grey value of one block (DC coefficients
quantised by 8, no others), a row of ROW blocks is a restart interval, and payloads of more than MAX_ROWS rows
become several images one after the other.  The thumbnail then is the payload.

Features: dimensions and a 64-bit gradient hash of the thumbnail (9 x 8 area means, each compared with its right
neighbour).

Defined results.  A null text is an empty one.  Payloads are padded with spaces to a positive multiple of ROW
bytes.  A very long text is held whole by its task, but encoded and decoded an image (1.6 MB) at a time.  Repeated rows are
separate media.  Progressive and arithmetic images raise ValueError.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, require, stored

ROW = 192
MAX_ROWS = 8191
#: Payload bytes handled at one time, but for longer single images.
SPAN = 1 << 20
#: Parts in which documents are stored as media and read back, one after the other.
SLICES = 2

# The zigzag-independent tables of the images written here.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8)
AC_LENGTHS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)
STEP = 8


def canonical_codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a table given by counts of codes of 1 to 16 bits."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _diff_table() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a whole block (DC difference and end of block) for differences -255 to 255."""
    dc, (end, end_bits) = canonical_codes(DC_LENGTHS, DC_SYMBOLS), canonical_codes(AC_LENGTHS, AC_SYMBOLS)[0]
    codes, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        value = d if d > 0 else d + (1 << size) - 1
        codes[d + 255] = (code << size | value) << end_bits | end if size else code << end_bits | end
        bits[d + 255] = n + size + end_bits
    return codes, bits


_CODES, _BITS = _diff_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([STEP] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Images of payloads whose lengths are positive multiples of ROW."""
    counts = [len(p) // ROW for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64)
    n = len(rows)
    diffs = np.empty_like(rows)
    diffs[:, 0] = rows[:, 0] - 128
    np.subtract(rows[:, 1:], rows[:, :-1], out=diffs[:, 1:])
    diffs += 255
    codes, bits = _CODES[diffs], _BITS[diffs]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    size = (total + 7) >> 3
    first = np.concatenate(([0], np.cumsum(size)))
    at = (ends - bits + first[:-1, None] * 8).ravel()
    shifted = codes.ravel() << (24 - bits.ravel() - (at & 7))
    byte = at >> 3
    packed = np.zeros(first[-1] + 2)
    for k, part in enumerate((shifted >> 16, shifted >> 8 & 255, shifted & 255)):
        packed += np.bincount(byte + k, weights=part, minlength=len(packed))
    packed = packed[: first[-1]].astype(np.uint8)
    packed[first[1:] - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)
    # stuffing after 0xFF, and a restart marker after each row but an image's last
    full = packed == 255
    row_of = np.repeat(np.arange(n), size)
    place = np.arange(len(packed)) + np.cumsum(full) - full + 2 * row_of
    out = np.zeros(len(packed) + int(full.sum()) + 2 * n, np.uint8)
    out[place] = packed
    row_end = place[first[1:] - 1] + full[first[1:] - 1] + 1
    in_image = np.concatenate([np.arange(c) % MAX_ROWS for c in counts])
    out[row_end], out[row_end + 1] = 255, 0xD0 + in_image % 8
    raw, result, row = out.tobytes(), [], 0
    row_start = np.concatenate(([0], row_end + 2))
    for c in counts:
        images = []
        for start in range(0, c, MAX_ROWS):
            own = min(MAX_ROWS, c - start)
            a, b = row_start[row + start], row_end[row + start + own - 1]
            images += [_head(own), raw[a:b], b"\xff\xd9"]
        result.append(b"".join(images))
        row += c
    return result


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int


@dataclass
class Scan:
    components: list[tuple[int, int, int]]  # place of the component, its DC and AC tables
    tables: dict[tuple[int, int], bytes]
    restart: int
    data: bytes


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, int]  # the DC step of each table
    scans: list[Scan] = field(default_factory=list)


def parse(raw: bytes) -> list[Image]:
    """All images of a stream, with their scans' entropy-coded bytes as they stand."""
    images: list[Image] = []
    at, quants, tables, restart = 0, {}, {}, 0
    while at < len(raw):
        if raw[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = raw[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            quants, tables, restart = {}, {}, 0
            continue
        if marker == 0xD9 or 0xD0 <= marker <= 0xD7:
            continue
        size = struct.unpack_from(">H", raw, at)[0]
        body = raw[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quants[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i] >> 4, body[i] & 15] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples are baseline")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            images.append(Image(width, height, parts, dict(quants)))
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            image = images[-1]
            image.quants.update(quants)
            places = {c.ident: i for i, c in enumerate(image.components)}
            own = [(places[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:
                end = raw.find(b"\xff", end)
                if end < 0 or end + 1 >= len(raw):
                    end = len(raw)
                    break
                if raw[end + 1] and not 0xD0 <= raw[end + 1] <= 0xD7:
                    break
                end += 2
            image.scans.append(Scan(own, dict(tables), restart, raw[at:end]))
            at = end
    return images


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow: bits << 8 | symbol of the code they begin with; 0 if there is none."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, bits) in canonical_codes(tuple(table[:16]), tuple(table[16:])).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return out


def _blocks(image: Image, scan: Scan) -> tuple[int, list[int]]:
    """Number of the scan's units and the component of each block of a unit."""
    wide, tall = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(scan.components) == 1:
        c = image.components[scan.components[0][0]]
        return -(-image.width * c.h // (8 * wide)) * -(-image.height * c.v // (8 * tall)), [0]
    units = -(-image.width // (8 * wide)) * -(-image.height // (8 * tall))
    return units, [i for i, (p, _, _) in enumerate(scan.components) for _ in range(image.components[p].h * image.components[p].v)]


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, without stuffing."""
    array = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(array == 255)
    at = at[at + 1 < len(array)]
    marks = at[(array[at + 1] >= 0xD0) & (array[at + 1] <= 0xD7)].tolist()
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *(m + 2 for m in marks)], [*marks, len(data)])]


def decode_scans(work: list[tuple[Image, Scan]]) -> list[list[np.ndarray]]:
    """DC coefficients (quantised) of each scan: an array of blocks in coded order for each of its components."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    layout = [_blocks(i, s) for i, s in work]
    for n, ((_, scan), (_, unit)) in enumerate(zip(work, layout)):
        kinds = tuple((scan.tables[0, d], scan.tables[1, a]) for _, d, a in scan.components)
        groups[kinds, tuple(unit)].append(n)
    out: list[list[np.ndarray]] = [[] for _ in work]
    for (kinds, unit), members in groups.items():
        lanes, blocks, owner = [], [], []
        for n in members:
            scan, units = work[n][1], layout[n][0]
            each = scan.restart or units
            own = _intervals(scan.data)
            if len(own) != max(1, -(-units // each)):
                raise ValueError(f"{len(own)} restart intervals, {-(-units // each)} expected")
            lanes += own
            blocks += [min(each, units - k * each) * len(unit) for k in range(len(own))]
            owner += [n] * len(own)
        dc = _lock_step(lanes, np.array(blocks), kinds, unit)
        first = 0
        while first < len(lanes):
            n, last = owner[first], first
            while last < len(lanes) and owner[last] == n:
                last += 1
            flat = np.concatenate([dc[i, : blocks[i]] for i in range(first, last)])
            kind = np.tile(np.array(unit), len(flat) // len(unit))
            out[n] = [flat[kind == c] for c in range(len(kinds))]
            first = last
    return out


def _lock_step(lanes: list[bytes], blocks: np.ndarray, kinds: tuple, unit: tuple[int, ...]) -> np.ndarray:
    """Decode intervals at once: lane i's blocks[i] blocks, whose components repeat as `unit`.  Returns the DC values."""
    sizes = np.array([len(x) for x in lanes])
    data = np.frombuffer(b"".join(lanes) + b"\0" * 8, np.uint8).astype(np.uint32)
    words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    ends = np.cumsum(sizes)
    at = (ends - sizes) * 8
    limit = ends * 8
    dc_tables, ac_tables = [_lookup(d) for d, _ in kinds], [_lookup(a) for _, a in kinds]
    out = np.zeros((len(lanes), int(blocks.max(initial=0))), np.int32)
    last = np.zeros((len(kinds), len(lanes)), np.int64)
    live = np.arange(len(lanes))
    peek = lambda p: (words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
    fewest = int(blocks.min(initial=0))
    for b in range(out.shape[1]):
        if b >= fewest:
            live = live[blocks[live] > b]
        own = unit[b % len(unit)]
        p = at[live]
        found = dc_tables[own][peek(p)].astype(np.int64)
        if not found.all():
            raise ValueError("a code that the table does not have")
        p += found >> 8
        size = found & 15
        value = peek(p).astype(np.int64) >> (16 - size)
        p += size
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        last[own, live] += value
        out[live, b] = last[own, live]
        # the other coefficients: only how long they are
        k = np.ones(len(live), np.int64)
        todo = slice(None)
        while True:
            q = p[todo]
            found = ac_tables[own][peek(q)].astype(np.int64)
            if not found.all():
                raise ValueError("a code that the table does not have")
            size, run = found & 15, found >> 4 & 15
            p[todo] = q + (found >> 8) + size
            k[todo] = np.where(size > 0, k[todo] + run + 1, np.where(run == 15, k[todo] + 16, 64))
            open_ = np.flatnonzero(k < 64)
            if not len(open_):
                break
            todo = open_
        if (p > limit[live]).any():
            raise ValueError("an interval ends too early")
        at[live] = p
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """Luminance samples (uint8), one for each 8 x 8 block of the first component, cut to the image's size."""
    work = [(i, s) for i in images for s in i.scans if any(p == 0 for p, _, _ in s.components)]
    out = []
    for (image, scan), found in zip(work, decode_scans(work)):
        place = next(i for i, (p, _, _) in enumerate(scan.components) if p == 0)
        c, dc = image.components[0], found[place]
        wide, tall = max(x.h for x in image.components), max(x.v for x in image.components)
        w, h = -(-image.width * c.h // (8 * wide)), -(-image.height * c.v // (8 * tall))
        if len(scan.components) > 1:
            across = -(-image.width // (8 * wide))
            dc = dc.reshape(-1, across, c.v, c.h).transpose(0, 2, 1, 3).reshape(-1, across * c.h)[:h, :w]
        else:
            dc = dc.reshape(h, w)
        level = dc.astype(np.int64) * image.quants[c.quant]
        out.append(np.clip((level + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def _means(grid: np.ndarray, n: int) -> np.ndarray:
    """Means of n bands of rows; rows serve several bands where there are fewer."""
    edges = np.arange(n) * len(grid) // n
    ends = np.maximum(np.append(edges[1:], len(grid)), edges + 1)
    return np.stack([grid[a:b].sum(axis=0, dtype=np.float64) / (b - a) for a, b in zip(edges, ends)])


def gradient_hash(thumb: np.ndarray) -> str:
    """16 hexadecimal digits."""
    grid = _means(_means(thumb, 8).T, 9).T
    return np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes().hex()


def decode(media: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """For each stream its thumbnail (those of several images one below the other), width and height.

    Images are decoded together up to SPAN coded bytes.
    """
    parsed = [parse(m) for m in media]
    found: list[np.ndarray] = []
    group, held = [], 0
    for image in (i for own in parsed for i in own):
        size = sum(len(s.data) for s in image.scans)
        if group and held + size > SPAN:
            found += thumbnails(group)
            group, held = [], 0
        group.append(image)
        held += size
    thumbs, out = iter(found + thumbnails(group)), []
    for own in parsed:
        mine = [next(thumbs) for _ in own]
        out.append((np.concatenate(mine) if len(mine) > 1 else mine[0], own[0].width, sum(i.height for i in own)))
    return out


def _spans(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with SPAN bytes of a column or one row."""
    start, total = 0, 0
    sizes = [len(x) if x is not None else 0 for x in batch.column(name).to_pylist()]
    for i, size in enumerate(sizes):
        if i > start and total + size > SPAN:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a JPEG stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _spans(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                padded = [r + b" " * (-len(r) % ROW if r else ROW) for r in raw]
                media = encode(padded) if len(padded) > 1 else [b"".join(encode([padded[0][i : i + ROW * MAX_ROWS]])[0] for i in range(0, len(padded[0]), ROW * MAX_ROWS))]
                arrays = [part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])

    return require(docs, "doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from media: payload digests, dimensions and the thumbnail's hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _spans(batch, "media"):
                streams = part.column("media").to_pylist()
                rows = []
                for doc, n, m, (thumb, w, h) in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), streams, decode(streams)):
                    payload = thumb.tobytes()
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((doc, n, len(payload), digest, zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), gradient_hash(thumb), w, h))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds))
    return media.mapInArrow(read, schema)


def round_trip(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """What `described` reads back of the media that `store` has written to the shared folder, one slice at a time.

    A slice's media are removed when their features are stored, so that the disk holds one slice of them.
    """
    rows, out = require(docs, "doc_id", "text"), None
    for i in range(slices):
        media = stored(store(rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == i)), "media")
        own = stored(described(media), "media-features")
        discard(media)
        out = own if out is None else out.union(own)
    return out
