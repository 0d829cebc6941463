"""Token ids as entropy-coded files: static range asymmetric numeral systems.

One frequency table, counted over all documents, serves every file.  Ids lie in ascending order of
their documents; a segment holds whole documents up to ``SEGMENT`` ids (a longer document is a
segment of its own) and is one row of a Spark-written table, so files appear whole or not at all
and any file system of Spark's will do.  Inside a segment:

* independent blocks of ``BLOCK`` ids, each coded on ``LANES`` interleaved states (64 bits, 32-bit
  words, ``BITS`` bits of frequency), last id first;
* a checkpoint every ``CHECKPOINT`` ids: all states and the place in the words, from which
  decoding can start.  A reader decodes all checkpoints' stretches of a segment side by side;
* a CRC-32 of every stretch's ids, of the frequency table and of the payload.

Layout of a payload (little endian): ``MAGIC``, version, lanes, ids per checkpoint, checkpoints per
block, ids, stretches, words, table CRC; then per stretch its first word (u32), CRC of its ids
(u32) and ``LANES`` states (u64); then the words (u32)
and the CRC of all before.

Defined cases: a null text is an empty one and has the end id alone; documents without an id come
first; rows that share an id are ordered by a hash of their ids and, if all ids are equal, in any
order, as they are alike; an empty table gives an empty file; invalid UTF-8 is replaced by U+FFFD
before encoding; a very long document is held whole in one worker.  A damaged payload or a
table that is not the file's raises ``ValueError``.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, clean_utf8, materialize, prepare, shared_dir, utf8
from .slices import encoder, forget

BITS = 20
LANES, CHECKPOINT, BLOCK = 32, 8192, 16384
SEGMENT = 1 << 21
MAGIC, VERSION = b"RTOK", 1
_HEAD = "<4sHHIIQIII"
_LOW = np.uint64(1 << 31)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 where the count is not 0, near the shares."""
    counts = np.asarray(counts, np.int64)
    total, room = int(counts.sum()), 1 << BITS
    if np.count_nonzero(counts) > room // 2:
        raise ValueError(f"more than {room // 2} different ids")
    if not total:
        return np.zeros(len(counts), np.uint32)
    share = np.array([int(c) * room // total for c in counts], np.int64)
    share[(counts > 0) & (share == 0)] = 1
    order = np.lexsort((np.arange(len(counts)), -share))
    left = room - int(share.sum())
    if left > 0:
        share[order[0]] += left
    for i in order:  # too much was given to rare ids: frequent ones pay, at most half of theirs
        if left >= 0:
            break
        give = min(-left, int(share[i]) // 2)
        share[i] -= give
        left += give
    return share.astype(np.uint32)


class Table:
    """A frequency table ready for coding."""

    def __init__(self, freq: np.ndarray):
        self.crc = zlib.crc32(np.asarray(freq, "<u4").tobytes())
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


@functools.lru_cache(maxsize=2)
def _table(freq: bytes) -> Table:
    return Table(np.frombuffer(freq, "<u4"))


def encode_segment(ids: np.ndarray, table: Table) -> bytes:
    """The payload of the ids of one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    steps_of = np.full(blocks, BLOCK // LANES)
    if blocks:
        steps_of[-1] = -(-(n - (blocks - 1) * BLOCK) // LANES)
    padded = np.full(blocks * BLOCK, int(table.freq.argmax()) if n else 0, np.int64)  # the commonest id costs least
    padded[:n] = ids
    if n and (table.freq[ids] == 0).any():
        raise ValueError("an id has no frequency in the table")
    grid = padded.reshape(blocks, BLOCK // LANES, LANES)
    most = int(steps_of.max(initial=0))
    state = np.full((blocks, LANES), _LOW, np.uint64)
    out = np.zeros((most, blocks, LANES), bool)
    words = np.zeros((most, blocks, LANES), np.uint32)
    every = CHECKPOINT // LANES
    kept = np.zeros((-(-most // every), blocks, LANES), np.uint64)
    for t in range(most - 1, -1, -1):
        live = blocks if t < steps_of[-1] else blocks - 1  # only the last block may be short
        ids_t = grid[:live, t]
        f = table.freq[ids_t]
        x = state[:live]
        flush = x >= (f << np.uint64(63 - BITS))
        words[t, :live] = x & np.uint64(0xFFFFFFFF)
        out[t, :live] = flush
        x = np.where(flush, x >> np.uint64(32), x)
        q = x // f
        state[:live] = (q << np.uint64(BITS)) + (x - q * f) + table.start[ids_t]
        if t % every == 0:
            kept[t // every] = state
    by_block = out.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[by_block]
    per_step = np.cumsum(by_block.sum(axis=2).ravel())  # words up to and with each (block, step)
    stretches, raw = [], np.ascontiguousarray(ids, "<u4").tobytes()
    for b in range(blocks):
        for k in range(-(-int(steps_of[b]) // every)):
            a = b * most + k * every
            lo = b * BLOCK + k * CHECKPOINT
            crc = zlib.crc32(raw[4 * lo:4 * min(lo + CHECKPOINT, (b + 1) * BLOCK)])
            stretches.append(struct.pack("<II", int(per_step[a - 1]) if a else 0, crc) + kept[k, b].astype("<u8").tobytes())
    head = struct.pack(_HEAD, MAGIC, VERSION, LANES, CHECKPOINT, BLOCK // CHECKPOINT, n, len(stretches), len(stream), table.crc)
    payload = b"".join([head, *stretches, stream.astype("<u4").tobytes()])
    return payload + struct.pack("<I", zlib.crc32(payload))


def decode_segment(payload: bytes, table: Table) -> np.ndarray:
    """The ids of a payload, all stretches side by side; raises if anything disagrees."""
    if len(payload) < 4 or struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise ValueError("the payload is damaged")
    try:
        magic, version, lanes, every, _, n, count, n_words, crc = struct.unpack_from(_HEAD, payload)
        if (magic, version) != (MAGIC, VERSION) or not lanes or not every or count != -(-n // every):
            raise ValueError("not a payload of this version")
        if crc != table.crc:
            raise ValueError("the frequency table is not the file's")
        place = np.frombuffer(payload, np.dtype([("word", "<u4"), ("crc", "<u4"), ("state", "<u8", (lanes,))]), count, struct.calcsize(_HEAD))
        words = np.frombuffer(payload, "<u4", n_words, struct.calcsize(_HEAD) + place.nbytes)
    except struct.error as e:
        raise ValueError("not a payload") from e
    ids = decode_stretches(place["state"], place["word"], words, np.minimum(n - np.arange(count) * every, every), every, table)
    raw = ids.astype("<u4").tobytes()
    for i, want in enumerate(place["crc"].tolist()):
        if zlib.crc32(raw[4 * i * every:4 * (i + 1) * every]) != want:
            raise ValueError(f"checksum of stretch {i} disagrees")
    return ids


def decode_stretches(state: np.ndarray, word: np.ndarray, words: np.ndarray, size: np.ndarray, every: int, table: Table) -> np.ndarray:
    """Ids of stretches given by their states, first words and numbers of ids; the last may be short."""
    count, lanes = state.shape if len(state) else (0, 1)
    x, at = state.astype(np.uint64), word.astype(np.int64)
    out = np.zeros((count, -(-every // lanes), lanes), np.uint32)
    steps = -(-size // lanes)
    low, words = np.uint64((1 << BITS) - 1), np.append(words, np.uint32(0))
    for t in range(int(steps.max(initial=0))):
        live = count if t < steps[-1] else count - 1
        slot = x[:live] & low
        s = table.symbol[slot]
        out[:live, t] = s
        v = table.freq[s] * (x[:live] >> np.uint64(BITS)) + slot - table.start[s]
        need = v < _LOW
        ends = need.sum(axis=1)
        get = words[np.minimum(np.repeat(at[:live] - (np.cumsum(ends) - ends), ends) + np.arange(int(ends.sum())), len(words) - 1)]
        v[need] = (v[need] << np.uint64(32)) | get
        x[:live] = v
        at[:live] += ends
    return out.reshape(count, out.shape[1] * lanes)[:, :every].ravel()[:int(size.sum())]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(clean_utf8(column))


def token_rows(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens``: the library's ids and the end id of each text as little-endian
    unsigned integers, of 16 bits if the vocabulary allows it, else of 32."""
    def run(batches):
        claim("rans", forget)
        for batch in batches:
            code = encoder(path)
            data, offsets = _texts(batch.column(1))
            ids, ends = code.encode(data, offsets)
            n = len(offsets) - 1
            kind = "<u2" if max(len(code.bytes_of), end_id + 1) <= 1 << 16 else "<u4"
            values = np.full(len(ids) + n, end_id, kind)
            size = np.diff(ends)
            values[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids
            cut = values.itemsize * (ends + np.arange(n + 1))
            blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), blob.cast(pa.binary()), pa.array(size + 1)], ["doc_id", "ids", "n_tokens"])

    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def _ids(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of :func:`token_rows` bytes."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: one partial row per id and task; the sum has a row per id of the
    vocabulary, which bounds what reaches the driver."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = utf8(batch.column(0))
            part = np.bincount(_ids(data.tobytes(), pa.compute.sum(batch.column(1)).as_py() or 0), minlength=len(total))
            part[:len(total)] += total
            total = part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    out[ids] = n
    return out


SEGMENTS = "part int, first long, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary"


def write(tokens: DataFrame, path: str, segment_ids: int = SEGMENT) -> None:
    """Write ``tokens (doc_id, ids, n_tokens)`` in ascending order of doc_id: the folder
    ``path/table`` holds the frequencies, ``path/segments`` the coded ids and their documents."""
    spark = tokens.sparkSession
    freq = quantise(count_ids(tokens))
    rows = pa.table({"id": pa.array(np.flatnonzero(freq).astype(np.int64)), "freq": pa.array(freq[freq > 0].astype(np.int64))})
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    packed = freq.astype("<u4").tobytes()

    def run(batches):
        table, first, part = _table(packed), 0, TaskContext.get().partitionId()
        names, sizes, pieces, held = [], [], [], 0

        def segment():
            ids = np.concatenate(pieces).astype(np.int64)
            columns = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                       pa.array([sizes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_segment(ids, table)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "first", "doc_ids", "n_tokens", "n_ids", "payload"])

        for batch in batches:
            for name, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = _ids(raw.as_py(), n)
                if held and held + len(ids) > segment_ids:
                    yield segment()
                    first, names, sizes, pieces, held = first + held, [], [], [], 0
                names.append(name)
                sizes.append(len(ids))
                pieces.append(ids)
                held += len(ids)
        if names:
            yield segment()

    # The row's own number keeps a crowd of equal rows from being one indivisible range.
    keys = ["doc_id", "tie", "row"]
    numbered = tokens.select("doc_id", "ids", "n_tokens", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions("doc_id", "tie", "ids", "row")
    ordered.select("doc_id", "ids", "n_tokens").mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The frequencies by id (a row per id of the vocabulary)."""
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").toArrow()
    ids = rows.column("id").to_numpy()
    freq = np.zeros(int(ids.max(initial=-1)) + 1, np.uint32)
    freq[ids] = rows.column("freq").to_numpy()
    return freq


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a written folder: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens, ids_crc32`` and, if wanted, ``ids`` (little-endian unsigned 32-bit)."""
    prepare(spark)
    packed = read_table(spark, path).astype("<u4").tobytes()
    stored = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # A row per file part (a bounded number of tasks wrote them) with the ids before it.
    parts = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in parts], np.append(0, np.cumsum([n for _, n in parts]))[:-1].tolist()))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches):
        table = _table(packed)
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, names, sizes, payload = (batch.column(i)[row] for i in range(5))
                ids = decode_segment(payload.as_py(), table)
                size = np.array(sizes.as_py(), np.int64)
                if size.sum() != len(ids):
                    raise ValueError("documents and ids of a segment do not belong together")
                ends, raw = np.cumsum(size), ids.astype("<u4").tobytes()
                cut = [raw[4 * (e - s):4 * e] for s, e in zip(size.tolist(), ends.tolist())]
                columns = [pa.array(names.as_py(), pa.int64()), pa.array(before[part.as_py()] + first.as_py() + ends - size), pa.array(size),
                           pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:4 + with_ids])

    return stored.select("part", "first", "doc_ids", "n_tokens", "payload").mapInArrow(run, out)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, segment_ids: int = SEGMENT) -> str:
    """Encode and write ``docs (doc_id, text)``; the folder's path (new, in shared storage, by default)."""
    path = path or shared_dir(docs.sparkSession, "token-files")
    write(materialize(token_rows(docs, vocabulary, end_id), "token-rows"), path, segment_ids)
    return path
