"""Token ids of the tokenizers library, with the ids of slices that were met before kept.

A byte-level tokenizer that cuts texts by the usual pattern never lets a slice run over the place
where white space follows another character, nor where a sign follows a letter.  So a text may be cut
at these places (ASCII ones), equal cuts need the library once, and the ids of the whole text are those of its cuts end to end.  Cuts are found,
hashed and looked up as arrays; a kept cut is used only if all its bytes are equal, so a hash
decides nothing.  Cuts not met before go to the library joined into longer texts, whose ids fall
apart again at the cuts' byte ends.
"""

from __future__ import annotations

import functools
import os

import numpy as np

#: Longer cuts (bytes) are not kept; so many cuts are kept, then all are forgotten.
LONGEST, MOST = 48, 700_000
_BITS = 21
_SLOTS = 1 << _BITS
_JOINED = 256
_PLACE = np.random.default_rng(20).integers(1, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGNS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id; ids outside the vocabulary have none, special tokens their string's."""
    known, special = byte_alphabet(), tokenizer.get_added_tokens_decoder()
    out = [b""] * (max(tokenizer.get_vocab().values(), default=-1) + 1)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.encode() if i in special else bytes(known[c] for c in token)
    return out


class SliceEncoder:
    """Ids of texts by one tokenizer file; ``plain_special``: strings of special tokens are text."""

    def __init__(self, path: str, plain_special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_special
        self.bytes_of = token_bytes(self.library)
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.signs = np.zeros(256, bool)
        self.signs[_SIGNS] = True
        for token in self.library.get_added_tokens_decoder().values():  # their strings stay whole
            self.signs[[b for a, b in zip(token.content.encode(), token.content.encode()[1:]) if _LETTER[a]]] = False
        self.clear()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of all cuts: the start of every text that is not empty, every blank after a character
        that is certainly not white space, and every sign after an ASCII letter."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        if n > 1:
            at = np.flatnonzero(_BLANK[data[1:]] & ~_ASCII_SPACE[data[:-1]]) + 1
            wide = at[data[at - 1] >= 0x80]
            last, before, first = data[wide - 1], data[wide - 2], data[np.maximum(wide - 3, 0)]
            space = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
            space |= (first == 0xE1) & (before == 0x9A) | (first == 0xE2) & (before == 0x81) & (last == 0x9F)
            space |= (first == 0xE2) & (before == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
            space |= (first == 0xE3) & (before == 0x80) & (last == 0x80)
            start[at] = True
            start[wide[space]] = False
            start[1:n] |= self.signs[data[1:]] & _LETTER[data[:-1]]
        start[offsets[:-1]] = True
        return np.flatnonzero(start[:n])

    def clear(self) -> None:
        #: Whether the bytes of all ids handed out were those of their cuts.
        self.exact = True
        self.tokens = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.token_at = np.cumsum(self.width) - self.width
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.n = 0
        self.hash, self.first, self.count, self.text = (np.zeros(1024, t) for t in (np.uint64, np.int64, np.int32, np.int64))
        self.ids, self.n_ids = np.zeros(4096, np.int32), 0
        self.blob, self.n_blob = np.zeros(4096, np.uint8), 0

    def _library(self, blob: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that lie end to end in ``blob``, and the number of each one's ids."""
        end = np.cumsum(length)
        first, last = blob[end - length], blob[end - 1]
        # A cut may follow another one only if it starts blank and the other ends otherwise.
        free = _BLANK[first] & (last < 0x80) & ~_ASCII_SPACE[last]
        new = ~free | np.append(True, ~free[:-1])
        run = np.cumsum(new)
        new |= (np.arange(len(length)) - np.flatnonzero(new)[run - 1]) % _JOINED == 0
        raw, start = blob.tobytes(), (end - length)[new]
        found = []
        texts = [raw[x:y].decode() for x, y in zip(start.tolist(), [*start[1:].tolist(), len(raw)])]
        for a in range(0, len(texts), 256):
            for e in self.library.encode_batch(texts[a:a + 256], add_special_tokens=False):
                found.append(np.array(e.ids, np.int32))
        ids = np.concatenate(found)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), end) + 1, prepend=0)

    def _append(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """New entries for segments of ``data``; their numbers."""
        if not len(start):
            return np.zeros(0, np.int64)
        at = np.cumsum(length) - length
        blob = data[np.repeat(start - at, length) + np.arange(int(length.sum()))]
        ids, size = self._library(blob, length)
        width = self.width[ids]
        if self.exact:
            end = np.cumsum(width)
            self.exact = bool(np.array_equal(end[np.cumsum(size) - 1], np.cumsum(length)) and np.array_equal(
                self.tokens[np.repeat(self.token_at[ids] - (end - width), width) + np.arange(len(blob))], blob))
        n = len(start)
        for name, values, a in (("hash", hashes, self.n), ("first", self.n_ids + np.cumsum(size) - size, self.n), ("count", size, self.n),
                                ("text", self.n_blob + at, self.n), ("ids", ids, self.n_ids), ("blob", blob, self.n_blob)):
            array = getattr(self, name)
            if a + len(values) > len(array):
                array = np.concatenate([array, np.zeros(a + len(values) - len(array) + len(array) // 4, array.dtype)])
                setattr(self, name, array)
            array[a:a + len(values)] = values
        self.n, self.n_ids, self.n_blob = self.n + n, self.n_ids + len(ids), self.n_blob + len(blob)
        return np.arange(self.n - n, self.n)

    def _place(self, entries: np.ndarray) -> None:
        pos = (self.hash[entries] >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(entries):
            free = self.slot[pos] < 0
            self.slot[pos[free]] = entries[free]
            left = self.slot[pos] != entries
            entries, pos = entries[left], (pos[left] + 1) % _SLOTS

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        todo, pos = np.arange(len(hashes)), (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(todo):
            entry = self.slot[pos]
            same = (entry >= 0) & (self.hash[entry] == hashes[todo])
            out[todo[same]] = entry[same]
            go = (entry >= 0) & ~same
            todo, pos = todo[go], (pos[go] + 1) % _SLOTS
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and each text's end among them (``n + 1`` offsets).
        ``data`` is valid UTF-8 cut by ``offsets``."""
        if self.n > MOST:
            self.clear()
        start = self.cuts(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        size = np.diff(np.append(start, len(data)))
        place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
        value = _PLACE[np.minimum(place, LONGEST - 1)]
        value *= data + np.uint64(1)
        hashes = np.add.reduceat(value, start)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        del value
        long = size > LONGEST
        entry = np.where(long, -1, self._find(hashes))
        new = np.flatnonzero((entry < 0) & ~long)
        if len(new):
            _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            room = max(0, _SLOTS // 2 - self.n)  # of one very long text, more may be new than can be kept
            at = self._append(data, start[one[:room]], size[one[:room]], hashes[one[:room]])
            self._place(at)
        kept = (self.n, self.n_ids, self.n_blob)
        if len(new):
            rest = self._append(data, start[one[room:]], size[one[room:]], hashes[one[room:]])
            entry[new] = np.append(at, rest)[back]
        # All bytes of a cut must be those of its entry; others, and long cuts, are encoded for now.
        safe = np.where(long, 0, entry)
        equal = self.blob[np.minimum(np.repeat(self.text[safe], size) + place, max(self.n_blob - 1, 0))] == data
        other = np.flatnonzero(long | ~np.logical_and.reduceat(equal, start))
        del equal, place
        if len(other):
            entry[other] = self._append(data, start[other], size[other], hashes[other])
        count = self.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[entry] - (ends - count), count) + np.arange(ends[-1])]
        self.n, self.n_ids, self.n_blob = kept
        text_end = np.append(0, ends)[np.searchsorted(start, offsets)]
        return ids, text_end


@functools.lru_cache(maxsize=2)
def _encoder(path: str, plain_special: bool) -> SliceEncoder:
    return SliceEncoder(path, plain_special)


def encoder(path: str, plain_special: bool = False) -> SliceEncoder:
    """This worker's encoder for a tokenizer file; the operator that uses it claims the worker."""
    return _encoder(path, plain_special)


def forget() -> None:
    """Drop this worker's encoders."""
    _encoder.cache_clear()
