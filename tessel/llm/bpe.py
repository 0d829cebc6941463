"""Byte-level BPE: scan-based pre-tokenisation, cached pair merging, offset-keeping decoding.

Pre-tokenisation reads a text as an array of codepoint classes.  Each class is a function on
the states of a small automaton; the functions close under composition into a finite monoid,
so the state before every character comes from an associative prefix scan over bytes that name
monoid elements (one table lookup per composition).  A second table turns (state, class) into
slice starts.  No regular expression runs on the text.

Defined cases: a null text is an empty one (no slices, no ids); invalid UTF-8 is replaced by U+FFFD
before offsets are taken; invalid vocabulary paths raise;
repeated rows are encoded alike; rows are never split, merged or dropped.  One text is held
whole in a worker (Arrow batches are bounded in bytes, a longer text is a batch of its own).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, clean_utf8, prepare, runs, utf8

# Classes.  Letters that can belong to a contraction ('s 't 'm 'd 're 've 'll) have their own.
END, SPACE, BLANK, LETTER, STMD, LETTER_E, LETTER_RV, LETTER_L, NUMBER, QUOTE, OTHER = range(11)
LETTERS = (LETTER, STMD, LETTER_E, LETTER_RV, LETTER_L)

# States: what stands just before a character.
#   FRESH   start of text, or a finished contraction      IN_L, IN_N, IN_O  inside a run
#   SP, WS  a space / other white space                   QUOTED  a quote that began a slice
#   WANT_E, WANT_L  quote + r|v, quote + l: a contraction if the second letter follows
FRESH, SP, WS, IN_L, IN_N, IN_O, QUOTED, WANT_E, WANT_L = range(9)


def _step(state: int, cls: int) -> tuple[int, bool, bool]:
    """(next state, a slice starts here, a slice started at the character before)."""
    waiting = state in (WANT_E, WANT_L)
    if cls == END:
        return FRESH, False, waiting
    if state in (SP, WS):
        if cls in (SPACE, BLANK):
            return (SP if cls == SPACE else WS), False, False
        run = IN_L if cls in LETTERS else IN_N if cls == NUMBER else IN_O
        if cls == QUOTE and state == WS:
            run = QUOTED
        return run, state == WS, True
    if state == QUOTED:
        if cls == STMD:
            return FRESH, False, False
        if cls in (LETTER_RV, LETTER_L):
            return (WANT_E if cls == LETTER_RV else WANT_L), False, False
        if cls in (QUOTE, OTHER):
            return IN_O, False, False
    if (state, cls) in ((WANT_E, LETTER_E), (WANT_L, LETTER_L)):
        return FRESH, False, False
    if cls in LETTERS:
        return IN_L, not (state == IN_L or waiting), waiting
    if cls == NUMBER:
        return IN_N, state != IN_N, waiting
    if cls in (SPACE, BLANK):
        return (SP if cls == SPACE else WS), True, waiting
    if state == IN_O:
        return IN_O, False, False
    return (QUOTED if cls == QUOTE else IN_O), True, waiting


@functools.cache
def _automaton():
    """Monoid tables: generator of each class, compose[f, g] (f first), apply[f, state], marks."""
    gens = [tuple(_step(s, c)[0] for s in range(9)) for c in range(11)]
    elements = [tuple(range(9))]
    index = {elements[0]: 0}
    for f in elements:  # grows while it is read
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    if len(elements) > 256:
        raise AssertionError("the monoid no longer fits a byte")
    apply = np.zeros((256, 16), np.uint8)
    for i, f in enumerate(elements):
        apply[i, :9] = f
    compose = np.zeros((256, 256), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            compose[i, j] = index[tuple(g[s] for s in f)]
    marks = np.zeros((16, 16), np.uint8)
    for s in range(9):
        for c in range(11):
            _, here, before = _step(s, c)
            marks[s, c] = here + 2 * before
    return np.array([index[g] for g in gens], np.uint8), compose.ravel(), apply.ravel(), marks.ravel()


@functools.cache
def class_table() -> bytes:
    """The class of every codepoint, by the Unicode tables of the installed tokenizer library;
    compressed, so that it travels with a task (building it takes a worker 100 MB)."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        kept = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        cps = np.frombuffer(bytes(kept.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)
        out[cps] = cls
    for chars, cls in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("e", LETTER_E), ("rv", LETTER_RV), ("l", LETTER_L)):
        out[[ord(c) for c in chars]] = cls
    return zlib.compress(out.tobytes())


@functools.lru_cache(maxsize=1)
def _classes(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def _scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of monoid elements, blockwise and then over the blocks."""
    _, compose, _, _ = _automaton()
    n = len(f)
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * 256 + int(out[i])]
        return out
    blocks = -(-n // width)
    lanes = np.zeros(blocks * width, np.uint8)
    lanes[:n] = f
    lanes = np.ascontiguousarray(lanes.reshape(blocks, width).T)
    for k in range(1, width):
        lanes[k] = compose[lanes[k - 1].astype(np.uint16) * 256 + lanes[k]]
    before = np.zeros(blocks, np.uint8)
    before[1:] = _scan(lanes[-1], width)[:-1]
    lanes = compose[before.astype(np.uint16)[None, :] * 256 + lanes]
    return np.ascontiguousarray(lanes.T).ravel()[:n]


def slice_starts(data: np.ndarray, offsets: np.ndarray, table: bytes) -> np.ndarray:
    """Byte positions, ascending, at which slices start in texts that lie end to end in ``data``."""
    gens, _, apply, marks = _automaton()
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) != len(cps):
        raise ValueError("a text is not valid UTF-8")
    cls = _classes(table)[cps]
    ends = np.searchsorted(lead, offsets[1:])  # of each text, in characters
    with_end = np.insert(cls, ends, END)
    state = np.zeros(len(with_end), np.uint8)
    state[1:] = apply[_scan(gens[with_end])[:-1].astype(np.uint16) * 16 + FRESH]
    mark = marks[state.astype(np.uint16) * 16 + with_end]
    starts = (mark & 1).astype(bool)
    starts[:-1] |= (mark[1:] & 2).astype(bool)
    kept = np.ones(len(with_end), bool)
    kept[ends + np.arange(len(ends))] = False
    return lead[starts[kept]]


_NONE = 1 << 40  # above every id


class Ranks(dict):
    """Token bytes -> id, with the id of every joinable pair of ids and of every byte beside it."""

    pairs: dict[int, int] | None = None
    single: list[int] = []


def _pairs(ranks: Ranks) -> dict[int, int]:
    if ranks.pairs is None:
        ranks.single = [ranks[bytes([i])] for i in range(256)]
        ranks.pairs = {
            a << 32 | b: i
            for token, i in ranks.items()
            for k in range(1, len(token))
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None
        }
    return ranks.pairs


def merge_pairs(piece: bytes, ranks: Ranks) -> list[int]:
    """Byte-pair merging: the lowest rank first, the leftmost of equals; O(n log n)."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 200:
        pairs = _pairs(ranks)
        get, single = pairs.get, ranks.single
        parts = [single[c] for c in piece]
        found = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            parts[i:i + 2] = [best]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << 32 | best, _NONE)
            if i < len(found):
                found[i] = get(best << 32 | parts[i + 1], _NONE)
        return parts
    end = list(range(1, n + 1))  # part that starts at i ends at end[i]; 0: no part starts here
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    """The ranks of a ``.tiktoken`` file (base64 of the token's bytes, a blank, its id)."""
    with open(path, "rb") as f:
        return Ranks((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Ids of a slice as packed little-endian 32-bit integers.  When ``most`` are held they
    become the old generation, which still answers; slices in use move on to the new one."""

    def __init__(self, ranks: Ranks, most: int):
        super().__init__()
        self.ranks, self.most, self.old = ranks, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece) or _pack(merge_pairs(piece, self.ranks))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache(load_ranks(path), 200_000)


def _drop() -> None:
    for held in (_cache, load_ranks, _table, _classes):
        held.cache_clear()


def encode_arrow(texts: pa.Array, path: str, table: bytes | None = None) -> pa.Array:
    """Struct of ids, byte end and id end of each slice, per text."""
    claim("bpe", _drop)
    table = table or class_table()
    data, offsets = utf8(texts)
    cache = _cache(path)
    blobs, per_slice, byte_ends, slices = [], [], [], np.zeros(len(offsets), np.int64)
    for a, b in runs(offsets, 500_000):
        lo, hi = offsets[a], offsets[b]
        if hi == lo:
            continue
        part = data[lo:hi]
        starts = slice_starts(part, offsets[a:b + 1] - lo, table)
        ends = np.append(starts[1:], hi - lo)
        raw = part.tobytes()
        found = [cache[raw[s:e]] for s, e in zip(starts.tolist(), ends.tolist())]
        blobs.append(b"".join(found))
        per_slice.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        byte_ends.append(ends + lo)
        slices[a + 1:b + 1] = np.diff(np.searchsorted(starts, offsets[a:b + 1] - lo))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ids = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
    token_end, byte_end, slice_end = np.cumsum(cat(per_slice)), cat(byte_ends), np.cumsum(slices)
    id_end = np.append(0, token_end)[slice_end]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(slice_end))
    lists = [
        pa.ListArray.from_arrays(pa.array(id_end, pa.int32()), pa.array(ids)),
        pa.ListArray.from_arrays(pa.array(slice_end, pa.int32()), pa.array(byte_end - offsets[:-1][owner], pa.int32())),
        pa.ListArray.from_arrays(pa.array(slice_end, pa.int32()), pa.array(token_end - id_end[:-1][owner], pa.int32())),
    ]
    return pa.StructArray.from_arrays(lists, ["ids", "slice_bytes", "slice_ids"])


@functools.lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end by id, and the start of each id in them."""
    tokens = sorted(((i, t) for t, i in load_ranks(path).items()))
    size = np.zeros(tokens[-1][0] + 2, np.int64)
    for i, t in tokens:
        size[i + 1] = len(t)
    return np.frombuffer(b"".join(t for _, t in tokens), np.uint8), np.cumsum(size)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array; a null list is empty."""
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))


def decode_arrow(encoded: pa.Array, path: str) -> pa.Array:
    """The bytes of each row's ids; the kept slice offsets must agree with them."""
    blob, starts = _table(path)
    ids, id_off = _flat(encoded.field("ids"))
    slice_bytes, s_off = _flat(encoded.field("slice_bytes"))
    slice_ids, _ = _flat(encoded.field("slice_ids"))
    ids = ids.astype(np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(starts) - 1):
        raise ValueError("an id is outside the vocabulary")
    size = starts[ids + 1] - starts[ids]
    ends = np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(len(id_off) - 1), np.diff(s_off))
    if not np.array_equal(ends[slice_ids + id_off[:-1][owner]] - ends[id_off[:-1]][owner], slice_bytes):
        raise ValueError("slice offsets and ids do not belong together")
    values = np.empty(ends[-1], np.uint8)
    for a in range(0, len(ids), 500_000):
        part = size[a:a + 500_000]
        lo, hi = ends[a], ends[min(a + 500_000, len(ids))]
        values[lo:hi] = blob[np.repeat(starts[ids[a:a + 500_000]] - (ends[a:a + len(part)] - lo), part) + np.arange(hi - lo)]
    offsets = pa.py_buffer(ends[id_off].astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(id_off) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


ENCODED = "struct<ids:array<int>,slice_bytes:array<int>,slice_ids:array<int>>"


def encode(text: Column, path: str) -> Column:
    """Struct of ``ids`` and, for each slice in order, the byte (``slice_bytes``) and the id
    (``slice_ids``) at which it ends.  ``path`` must be readable on every executor."""
    table = class_table()

    @F.arrow_udf(ENCODED)
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return encode_arrow(clean_utf8(texts), path, table)

    return bpe_encode(text)


def decode(encoded: Column, path: str) -> Column:
    """The bytes of the ids of an :func:`encode` struct; raises where its offsets disagree."""
    @F.arrow_udf("binary")
    def bpe_decode(rows: pa.Array) -> pa.Array:
        return decode_arrow(rows, path)

    return bpe_decode(encoded)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("string")
    def bpe_digest(lists: pa.Array) -> pa.Array:
        values, offsets = _flat(lists)
        raw = values.astype("<u4").tobytes()
        return pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())

    return bpe_digest(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and encoded text of each row; a map without any shuffle."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text_col).cast("string"), path).alias("encoded"))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per document: id count, digest of the ids, digest of the decoded bytes."""
    ids = F.col("encoded.ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids_digest(ids).alias("ids_sha256"),
                          F.sha2(decode(F.col("encoded"), path), 256).alias("decoded_sha256"))


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def document_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`digests` of :func:`encode_documents` gives, encoded and decoded by one worker: the
    ids need not pass through the JVM, and a task keeps one worker instead of two."""
    prepare(docs.sparkSession)
    table = class_table()

    @F.arrow_udf(DIGEST)
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        encoded = encode_arrow(clean_utf8(texts), path, table)
        values, ends = _flat(encoded.field("ids"))
        raw = values.astype("<u4").tobytes()
        ids = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        back = [hashlib.sha256(x.as_py()).hexdigest() for x in decode_arrow(encoded, path)]
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256"])

    done = docs.select(F.col(id_col).alias("doc_id"), bpe_round_trip(F.col(text_col).cast("string")).alias("done"))
    return done.select("doc_id", "done.*")
