"""Alignment of two tokenizers by an inverted index of pair bitmaps.

Tokens of both tokenizers cover the same bytes, so the places where either one ends cut a text into
stretches, each inside one token of A and one of B: these are the links, and the places where both
end cut the text into groups.

The index.  Documents are dealt into chunks of at most 65,536 documents and about ``LINKS`` links,
each filled by one task.  For every id pair of a chunk a posting holds, compressed,

* the documents: a sorted array of 16-bit numbers, or from ``DENSE`` documents on a bitmap of 65,536
  bits; the bitmaps of a task's batches are OR-merged into one;
* multiplicity planes: bit k of (links - 1) of every such document, for as many k as are needed.

A pair's document count is the sum of the popcounts of its chunks' bitmaps (chunks share no
document), its link count that of the planes, weighed by 2**k.  Counts go back to the postings by a
join on the pair, the postings to their chunk, and every posting hands its documents the pair's
count times the multiplicity: a chunk's documents are scored in one array, whatever their number of
links.  A pair that occurs everywhere is one row a chunk, not one a document.

Defined cases: null and empty texts, and texts whose tokens' bytes are not those of a space and the
text (as those with U+2581, or invalid UTF-8), have no tokens: zeros and an empty digest; null ids
are kept; rows that share an id, and repeated rows, are documents of their own; an empty table
gives no rows; a very long text is held whole in one worker, in a chunk of its own if need be.
Other columns of any name are left out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, clean_utf8, materialize, prepare, utf8
from .slices import SliceEncoder, encoder, forget

#: Links of a chunk (a batch more at most); documents of a pair from which its posting is a bitmap.
LINKS, DENSE = 1_500_000, 4096
CHUNK = 1 << 16


class PieceEncoder(SliceEncoder):
    """Ids of texts that begin with the space which the piece model itself would add.

    No piece holds a space after another character, so a text falls apart before every space that
    follows something else.  (U+2581 is a space to the model; a cut never follows it.)
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece of this model holds a space inside")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.space = self.model.piece_to_id("▁")
        self.clear()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        start = np.zeros(n + 1, bool)
        start[1:n] = (data[1:] == 32) & (data[:-1] != 32)
        at = np.flatnonzero(start[:n] & (np.append(0, data[:-1]) == 0x81)[:n])
        at = at[at >= 3]
        start[at[(data[at - 2] == 0x96) & (data[at - 3] == 0xE2)]] = False
        start[offsets[:-1]] = True
        return np.flatnonzero(start[:n])

    def _library(self, blob: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, end = blob.tobytes(), np.cumsum(length)
        texts = [raw[a + 1:b].decode() for a, b in zip((end - length).tolist(), end.tolist())]
        found = self.model.encode(texts, num_threads=1)
        found = [ids if text else [self.space] for ids, text in zip(found, texts)]
        size = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum())), size


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@functools.lru_cache(maxsize=1)
def _numerals(path_a: str, path_b: str) -> tuple[list[bytes], int]:
    """Decimal ids with what follows them: A inside a group, A last, B inside, B last."""
    a, b = len(encoder(path_a, True).bytes_of), len(_pieces(path_b).bytes_of)
    out = [f"{i}{end}".encode() for i in range(a) for end in ",|"] + [f"{i}{end}".encode() for i in range(b) for end in ",;"]
    return out, 2 * a


def _forget() -> None:
    forget()
    _pieces.cache_clear()
    _numerals.cache_clear()


def align(texts: pa.Array, path_a: str, path_b: str) -> dict:
    """Per text ``n_a, n_b, n_groups, n_links`` and ``sha``; per link ``row`` and ``pair``
    (A id * 2**24 + B id)."""
    claim("alignment", _forget)
    clean = clean_utf8(texts)
    n = len(clean)
    data, offsets = utf8(clean)
    before, _ = utf8(texts)
    some = np.diff(offsets) > 0
    if not np.array_equal(data, before):
        some &= np.array([a == b for a, b in zip(clean.cast(pa.binary()).to_pylist(), texts.cast(pa.binary()).to_pylist())])
    # A space in front of every text that takes part.
    size = np.where(some, np.diff(offsets) + 1, 0)
    out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), np.zeros((4, n), np.int64)), sha=[""] * n, row=np.zeros(0, np.int64), pair=np.zeros(0, np.uint64))
    ends = np.cumsum(size)
    if not some.any():
        return out
    offsets_of = np.append(0, ends)
    spaced = np.full(int(ends[-1]), 32, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[(ends - size)[some]] = False
    spaced[inside] = data if some.all() else data[np.repeat(some, np.diff(offsets))]
    code_a, code_b = encoder(path_a, True), _pieces(path_b)
    ids_a, end_a = code_a.encode(spaced, offsets_of)
    ids_b, end_b = code_b.encode(spaced, offsets_of)
    same = _joined(code_a, ids_a, end_a, spaced, offsets_of) & _joined(code_b, ids_b, end_b, spaced, offsets_of)
    row_a, row_b = np.repeat(np.arange(n), np.diff(end_a)), np.repeat(np.arange(n), np.diff(end_b))
    if not same.all():
        ids_a, row_a, ids_b, row_b = ids_a[same[row_a]], row_a[same[row_a]], ids_b[same[row_b]], row_b[same[row_b]]
        size = np.where(same, size, 0)
    if not len(ids_a):
        return out
    total = int(size.sum())
    ends_a, ends_b = np.zeros(total, bool), np.zeros(total, bool)
    ends_a[np.cumsum(code_a.width[ids_a]) - 1] = True
    ends_b[np.cumsum(code_b.width[ids_b]) - 1] = True
    at = np.flatnonzero(ends_a | ends_b)  # a link ends here
    ends_a, ends_b = ends_a[at], ends_b[at]
    both = ends_a & ends_b
    a, b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    out["row"] = row_a[a]
    out["pair"] = (ids_a[a].astype(np.uint64) << np.uint64(24)) | ids_b[b].astype(np.uint64)
    out["n_a"], out["n_b"] = np.bincount(row_a, minlength=n), np.bincount(row_b, minlength=n)
    out["n_links"] = np.bincount(out["row"], minlength=n)
    out["n_groups"] = np.bincount(out["row"][both], minlength=n)
    # Groups as text: A ids of a group, then its B ids.
    last_a, last_b = both[ends_a], both[ends_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    until_a, until_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
    numerals, skip = _numerals(path_a, path_b)
    parts = np.empty(len(ids_a) + len(ids_b), np.int64)
    parts[np.arange(len(ids_a)) + until_b[group_a]] = 2 * ids_a.astype(np.int64) + last_a
    parts[np.arange(len(ids_b)) + until_a[group_b]] = skip + 2 * ids_b.astype(np.int64) + last_b
    cut = np.append(0, np.cumsum(out["n_a"] + out["n_b"])).tolist()
    for i in np.flatnonzero(out["n_a"]).tolist():
        out["sha"][i] = hashlib.sha256(b"".join(map(numerals.__getitem__, parts[cut[i]:cut[i + 1]].tolist()))[:-1]).hexdigest()
    return out


def _joined(code: SliceEncoder, ids: np.ndarray, end: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, joined, are its bytes."""
    width = np.append(0, np.cumsum(code.width[ids]))[end]
    same = np.diff(width) == np.diff(offsets)
    if same.all() and code.exact:
        return same
    raw = data.tobytes()
    return np.array([b"".join([code.bytes_of[t] for t in ids[end[i]:end[i + 1]]]) == raw[offsets[i]:offsets[i + 1]] for i in range(len(same))])


POSTING = "chunk long, low int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs int, planes int, posting binary"


def postings(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Pair, number of documents, links and planes, and bytes of each posting, from link keys
    (pair * 2**16 + document)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    more = np.diff(np.append(first, len(keys))) - 1  # links beyond one
    keys = keys[first]
    low, pair = (keys & np.uint64(0xFFFF)).astype(np.uint16), keys >> np.uint64(16)
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    docs = np.diff(np.append(start, len(keys)))
    links = np.add.reduceat(more, start) + docs
    planes = np.frexp(np.maximum.reduceat(more, start).astype(np.float64))[1]  # bit length
    head = np.where(docs < DENSE, 2 * docs, CHUNK // 8)
    each = (docs + 7) // 8
    size = head + planes * each
    end = np.cumsum(size)
    blob = np.zeros(int(end[-1]), np.uint8)
    rank = np.arange(len(keys)) - np.repeat(start, docs)
    at, thin = np.repeat(end - size, docs), np.repeat(docs < DENSE, docs)
    for k in range(2):
        blob[(at + 2 * rank + k)[thin]] = (low[thin] >> np.uint16(8 * k)) & np.uint16(0xFF)
    wide = ~thin
    np.bitwise_or.at(blob, at[wide] + (low[wide] >> np.uint16(3)), np.left_shift(1, low[wide] & np.uint16(7)).astype(np.uint8))
    at, each_of = at + np.repeat(head, docs), np.repeat(each, docs)
    for k in range(int(planes.max(initial=0))):
        on = np.flatnonzero((more >> k) & 1)
        np.bitwise_or.at(blob, at[on] + k * each_of[on] + (rank[on] >> 3), np.left_shift(1, rank[on] & 7).astype(np.uint8))
    cut = np.append(0, end)
    raw = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(blob.tobytes())])
    return pair[start], docs, links, planes, raw.cast(pa.binary())


def read_postings(docs: np.ndarray, planes: np.ndarray, raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and multiplicity of everything that postings hold."""
    data, offsets = utf8(raw)
    docs, planes, start = docs.astype(np.int64), planes.astype(np.int64), offsets[:-1]
    row = np.repeat(np.arange(len(docs)), docs)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(docs) - docs, docs)
    thin = docs < DENSE
    at = start[row] + 2 * rank
    at[~thin[row]] = 0
    low = data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8) if len(row) else np.zeros(0, np.int64)
    ends = np.cumsum(docs)
    for i in np.flatnonzero(~thin).tolist():
        bits = np.unpackbits(data[start[i]:start[i] + CHUNK // 8], bitorder="little")
        low[ends[i] - docs[i]:ends[i]] = np.flatnonzero(bits)
    head, each = np.where(thin, 2 * docs, CHUNK // 8), (docs + 7) // 8
    times = np.ones(len(row), np.int64)
    for k in range(int(planes.max(initial=0))):
        on = np.flatnonzero(planes[row] > k)
        r = row[on]
        bit = data[start[r] + head[r] + k * each[r] + (rank[on] >> 3)] >> (rank[on] & 7).astype(np.uint8)
        times[on] += (bit & 1).astype(np.int64) << k
    return row, low, times


def index(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = LINKS) -> DataFrame:
    """Rows of documents (``pair`` null) and of postings, written once."""
    names = [f.split()[0] for f in POSTING.split(", ")]

    def batch_of(n: int, **given) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        columns = [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], kinds[t]) if k in given else pa.nulls(n, kinds[t])
                   for k, t in (f.split() for f in POSTING.split(", "))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        chunk, rows, links, keys = TaskContext.get().partitionId() << 20, 0, 0, []

        def flush():
            pair, n_docs, _, planes, raw = postings(np.concatenate(keys))
            for a in range(0, len(pair), 200_000):
                part = slice(a, a + 200_000)
                yield batch_of(len(pair[part]), chunk=np.full(len(pair[part]), chunk), pair=pair[part].astype(np.int64), docs=n_docs[part], planes=planes[part], posting=raw[part])

        for batch in batches:
            got, n = align(batch.column(1), path_a, path_b), batch.num_rows
            if rows and (rows + n > CHUNK or links + len(got["row"]) > chunk_links):
                if links:
                    yield from flush()
                chunk, rows, links, keys = chunk + 1, 0, 0, []
            keys.append((got["pair"] << np.uint64(16)) | (got["row"] + rows).astype(np.uint64))
            yield batch_of(n, chunk=np.full(n, chunk), low=np.arange(rows, rows + n), doc_id=batch.column(0), groups_sha256=got["sha"],
                           **{k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")})
            rows, links = rows + n, links + len(got["row"])
        if links:
            yield from flush()

    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(slim.mapInArrow(run, POSTING), "pair-index")


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, docs``: popcounts of each pair's bitmaps, summed per task before the shuffle."""
    return stored.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"))


def pair_table(stored: DataFrame) -> DataFrame:
    """``a_id, b_id, docs, links``: document counts by bitmaps, link counts by the planes."""
    def run(batches):
        for batch in batches:
            docs, planes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            row, _, times = read_postings(docs, planes, batch.column(3))
            links = np.zeros(batch.num_rows, np.int64)
            np.add.at(links, row, times)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(links)], ["pair", "docs", "links"])

    rows = stored.where("pair is not null").select("pair", "docs", "planes", "posting").mapInArrow(run, "pair long, docs long, links long")
    return rows.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")).select(
        F.shiftright("pair", 24).alias("a_id"), F.col("pair").bitwiseAND((1 << 24) - 1).alias("b_id"), "docs", "links")


def scores(stored: DataFrame) -> DataFrame:
    """``chunk, low, n_best, count_sum`` of every document with links."""
    def run(batches):
        now, best, total, seen = None, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64), np.zeros(CHUNK, bool)

        def done():
            low = np.flatnonzero(seen)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(low), now)), pa.array(low, pa.int32()), pa.array(best[low]), pa.array(total[low])],
                                             ["chunk", "low", "n_best", "count_sum"])
            for array in (best, total, seen):
                array[:] = 0
            return out

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            docs, planes, count, top = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
            row, low, times = read_postings(docs, planes, batch.column(3))
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            cut = np.searchsorted(row, np.append(first, len(chunk)))
            for i, a, b in zip(first, cut, cut[1:]):
                if chunk[i] != now:
                    if now is not None:
                        yield done()
                    now = chunk[i]
                seen[low[a:b]] = True
                np.add.at(total, low[a:b], times[a:b] * count[row[a:b]])
                np.add.at(best, low[a:b], times[a:b] * top[row[a:b]])
        if now is not None:
            yield done()

    counts = materialize(pair_counts(stored), "pair-counts")
    of = F.shiftright("pair", 24)
    most = counts.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))  # a row per id of A's vocabulary
    counted = (counts.join(F.broadcast(most), of == F.col("a")).select("pair", F.col("docs").alias("count"), (F.col("docs") == F.col("most")).alias("best")))
    held = stored.where("pair is not null").select("pair", "chunk", "docs", "planes", "posting").join(counted, "pair")
    return (held.select("chunk", "docs", "planes", "posting", "count", "best").repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(run, "chunk long, low int, n_best long, count_sum long"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = LINKS) -> DataFrame:
    """Per document its tokens, groups, links and scores."""
    stored = index(docs, path_a, path_b, id_col, text_col, chunk_links)
    rows = stored.where("low is not null").join(scores(stored), ["chunk", "low"], "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                       F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
