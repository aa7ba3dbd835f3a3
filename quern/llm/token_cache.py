"""Exact whole-text tokenization with a bounded memo of chunks between spaces.

Both supported tokenizers split text beforehand so that no token spans the boundary between a character that is no
white space and a following space or line feed.  A chunk with what stands before it (a space, a line feed or
nothing) can thus be encoded once by the `tokenizers` library and looked up afterwards.  Marks at the end of a chunk
that follow a letter are a chunk of their own, as both tokenizers part a run of letters from a run of marks; and
what the word tokenizer makes lower case is so beforehand.  Texts where that reasoning
does not hold (two white-space characters in a row, for the byte-level tokenizer; the string of a special or added token, which the library
gives that token's id) are encoded whole.

The memo is an open-addressing table in numpy arrays: chunks of a batch of texts are found, hashed and looked up by
array operations.  The hash only finds a place: the memo keeps each chunk's bytes, and every chunk that is looked up
is compared with them.  Where they differ the batch's chunks are encoded without the memo.  Chunks of more than LONGEST bytes are encoded
each time, so its slots bound the memo in bytes: 60 a slot at most, less in practice.  A worker keeps one encoder for its tasks and
frees it when it has not been used for IDLE seconds, so that it is not held through later stages.  Long texts are cut before a space or line feed into parts of SPAN bytes (a part without one is longer).
"""

from __future__ import annotations

import re
import string
import threading
import time

import numpy as np

#: Slots of the memo, a power of two; it is emptied when three fifths are taken, which costs time and never changes a result.
SLOTS = 1 << 21
#: Bytes of a chunk that the memo keeps.
LONGEST = 64
#: Seconds after which an unused encoder is freed.
IDLE = 3.0
#: Bytes of text handled at one time.
SPAN = 1 << 18

_RUN = re.compile(r"\s\s").search
_SPACE = re.compile(r"\s").search
_ODD = 0x9E3779B97F4A7C15
_MARK, _LETTER = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (string.punctuation, string.ascii_letters))
_ENCODERS: dict[tuple[str, str], "ChunkEncoder"] = {}


def _pieces(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of each piece, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def _without_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks and the places of each text's last, with the marks after a chunk's last letter as chunks of their own."""
    at = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[end - 1]  # of an empty chunk: before it
    # an ASCII letter, or one of those from U+00C0 to U+00FF
    other = (data[at - 1] == 0xC3) & (data[at] >= 0x80) & (data[at] != 0x97) & (data[at] != 0xB7)
    cut = (at >= start) & (at + 1 < end) & (_LETTER[data[at]] | other)
    place = np.arange(len(start)) + np.cumsum(cut) - cut
    n = len(start) + int(cut.sum())
    starts, ends, leads = np.empty(n, start.dtype), np.empty(n, end.dtype), np.full(n, 3)
    starts[place], ends[place], leads[place] = start, np.where(cut, at + 1, end), lead
    starts[place[cut] + 1], ends[place[cut] + 1] = at[cut] + 1, end[cut]
    return starts, ends, leads, place[last] + cut[last]


class Powers:
    """Prefix hashes: sum of table[byte] * odd**place, so that any slice's hash is a difference, times a power."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        self.odd = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, self.odd, np.uint64))))
                inverse = np.uint64(pow(self.odd, -1, 1 << 64))
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse, np.uint64))))

    def slices(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.reserve(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return (sums[end] - sums[start]) * self.down[start]


class ChunkEncoder:
    """encode_all(texts) -> little-endian uint32 id bytes per text, equal to tokenizing each text whole."""

    def __init__(self, path: str, kind: str, slots: int = SLOTS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.tokenizer = Tokenizer.from_file(path)
        # the library finds these in any text; upper and lower case are not told apart here
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added), re.I).search if added else lambda text: None
        self.byte, self.slots, self.shift = kind == "byte", slots, np.uint64(65 - slots.bit_length())
        self.mark = self._ids("\n" if self.byte else "0")
        if len(self.mark) != 1:
            raise ValueError("the separator is not a single token of this vocabulary")
        self.powers = Powers(1)
        self.used_at = time.monotonic()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)  # 0: free
        self.at = np.zeros(self.slots, np.int32)  # ids in flat
        self.size = np.zeros(self.slots, np.int32)
        self.text_at = np.zeros(self.slots, np.int32)  # bytes in text
        self.text_size = np.zeros(self.slots, np.int16)  # times 4, plus the lead
        self.flat = np.zeros(1 << 16, "<u4")
        self.text = np.zeros(1 << 16, np.uint8)
        self.used = self.text_used = self.taken = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self._ids(text), "<u4").tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of strings, most of them in joined runs that are cut again at a separator token that none holds."""
        own = "\n" if self.byte else "0"
        bare = [w[1:] if w[:1] == " " else w for w in words]
        odd = [not b or own in b or _SPACE(b) is not None for b in bare]
        plain = [w for w, o in zip(words, odd) if not o]
        glue, out = own if self.byte else f" {own} ", []
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(part) - 1:
                out += map(self.whole, part)
                continue
            raw, ends = ids.tobytes(), (cuts * 4).tolist()
            out += map(raw.__getitem__, map(slice, [0, *(x + 4 for x in ends)], [*ends, len(raw)]))
        done = iter(out)
        return [self.whole(w) if o else next(done) for w, o in zip(words, odd)]

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or -1."""
        slot = (key >> self.shift).astype(np.int64)
        found = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            own = slot[todo]
            held = self.keys[own]
            same = held == key[todo]
            found[todo[same]] = own[same]
            todo = todo[~same & (held != 0)]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return found

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        """self.<name>, grown to hold so many more entries."""
        array = getattr(self, name)
        while used + more > len(array):
            array = np.concatenate((array, np.zeros_like(array)))
        setattr(self, name, array)
        return array

    def _insert(self, key: np.ndarray, code: np.ndarray, ids: list[bytes], text: bytes, text_size: np.ndarray) -> None:
        flat = np.frombuffer(b"".join(ids), "<u4")
        self._room("flat", self.used, len(flat))[self.used : self.used + len(flat)] = flat
        self._room("text", self.text_used, len(text))[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        size = np.array([len(x) // 4 for x in ids], np.int32)
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        text_at = (self.text_used + np.cumsum(text_size) - text_size).astype(np.int32)
        self.used += len(flat)
        self.text_used += len(text)
        self.taken += len(key)
        slot = (key >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            own, place = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][place]
            self.keys[own], self.at[own], self.size[own], self.text_at[own], self.text_size[own] = key[put], at[put], size[put], text_at[put], code[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = np.where(self.keys[slot[todo]] != 0, (slot[todo] + 1) & (self.slots - 1), slot[todo])

    def _batch(self, raw: list[bytes]) -> list[bytes]:
        """Ids of texts or parts of texts.  A part that begins with a space or line feed begins with an empty chunk."""
        if self.taken > self.slots * 3 // 5:
            self._clear()
        joined = b"\n".join(raw) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        end = np.flatnonzero((data == 32) | (data == 10))
        start = np.empty_like(end)
        start[0] = 0
        start[1:] = end[:-1] + 1
        sizes = np.array([len(r) for r in raw])
        doc_end = np.cumsum(sizes + 1) - 1
        last = np.searchsorted(end, doc_end)  # each text's last chunk
        if self.byte:
            lead = np.empty(len(end), np.int64)  # 1: a space stands before, 2: a line feed, 3: nothing
            lead[0], lead[1:] = 3, np.where(data[end[:-1]] == 32, 1, 2)
            lead[last[:-1] + 1] = 3
        else:
            lead = np.full(len(end), 3)
        start, end, lead, last = _without_marks(data, start, end, lead, last)
        long = np.flatnonzero(end - start > LONGEST)
        code = np.minimum(end - start, LONGEST + 1) * 4 + lead  # what the memo compares beside the bytes
        key = self.powers.slices(data, start, end) + code.astype(np.uint64) * np.uint64(_ODD)
        key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        key[key == 0] = 1
        slot = self._find(key)
        slot[long] = 0
        gaps = np.flatnonzero(slot < 0)
        if len(gaps):
            _, place = np.unique(key[gaps], return_index=True)
            new = gaps[place]
            ids = self._coded(joined, start[new], end[new], lead[new])
            text = data[_pieces(start[new], end[new] - start[new])].tobytes()
            self._insert(key[new], code[new], ids, text, end[new] - start[new])
            slot[gaps] = self._find(key[gaps])
        size, at = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64)
        if len(long):  # these stand after the memo's ids for this batch only
            ids = self._coded(joined, start[long], end[long], lead[long])
            flat = np.frombuffer(b"".join(ids), "<u4")
            self._room("flat", self.used, len(flat))[self.used : self.used + len(flat)] = flat
            size[long] = [len(x) // 4 for x in ids]
            at[long] = self.used + np.cumsum(size[long]) - size[long]
        short = np.flatnonzero(end - start <= LONGEST)
        held = slot[short]
        if (self.text_size[held] != code[short]).any() or (self.text[_pieces(self.text_at[held], self.text_size[held] >> 2)] != data[_pieces(start[short], end[short] - start[short])]).any():
            return self._plain(joined, start, end, lead, last)
        total = np.cumsum(size)
        ids = self.flat[_pieces(at, size)].tobytes()
        cuts = [0, *(total[last] * 4).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _coded(self, joined: bytes, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> list[bytes]:
        """Ids of chunks, with what stands before them."""
        before = {1: " ", 2: "", 3: ""}
        words = [before[x] + joined[a:b].decode() for x, a, b in zip(lead.tolist(), start.tolist(), end.tolist())]
        line = np.array(self.mark, "<u4").tobytes()
        return [line + ids if x == 2 else ids for ids, x in zip(self._encode_words(words), lead.tolist())]

    def _plain(self, joined: bytes, start: np.ndarray, end: np.ndarray, lead: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The same without the memo: two chunks of the batch have one key."""
        ids, first = self._coded(joined, start, end, lead), [0, *(last[:-1] + 1).tolist()]
        return [b"".join(ids[a : b + 1]) for a, b in zip(first, last.tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        self.used_at = time.monotonic()
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            for (i, _), ids in zip(group, self._batch([r for _, r in group]) if group else ()):
                out[i].append(ids)
            group.clear()

        for i, text in enumerate(texts):
            if self.byte and _RUN(text) or self.added(text):
                out[i].append(self.whole(text))
                continue
            for raw in _parts(text.encode() if self.byte else text.encode().lower()):
                if group and held + len(raw) > SPAN:
                    flush()
                    held = 0
                group.append((i, raw))
                held += len(raw) + 1
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _parts(raw: bytes) -> list[bytes]:
    """A text cut before spaces or line feeds into parts of about SPAN bytes."""
    if len(raw) <= SPAN:
        return [raw]
    out, at = [], 0
    while len(raw) - at > SPAN:
        cut = max(raw.rfind(b" ", at + 1, at + SPAN), raw.rfind(b"\n", at + 1, at + SPAN))
        if cut < 0:
            later = [x for x in (raw.find(b" ", at + SPAN), raw.find(b"\n", at + SPAN)) if x >= 0]
            if not later:
                break
            cut = min(later)
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


def _free_idle() -> None:
    while _ENCODERS:
        time.sleep(IDLE / 4)
        for key, code in list(_ENCODERS.items()):
            if time.monotonic() - code.used_at > IDLE:
                _ENCODERS.pop(key, None)


def encoder(path: str, kind: str, slots: int = SLOTS) -> ChunkEncoder:
    """One per worker process and file, freed when it is idle."""
    found = _ENCODERS.get((path, kind))
    if found is None:
        found = ChunkEncoder(path, kind, slots)
        empty = not _ENCODERS
        _ENCODERS[path, kind] = found
        if empty:
            threading.Thread(target=_free_idle, daemon=True).start()
    found.used_at = time.monotonic()
    return found


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer, added ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
