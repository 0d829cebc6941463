"""Vector codes by Orchard search: integer product quantisation with exact nearest entries.

Each component x becomes floor(1024 * x); a vector is cut into equal consecutive parts, each with a
codebook of its own.  Codebooks start as the parts of the smallest vector ids and are moved to the
floored means of what they were assigned, a fixed number of rounds.

Search.  For every entry of a codebook the distances to all entries are held in ascending order.
A query walks the list of its current entry; a nearer entry (or an equally near one of a lower
index) becomes current and the walk goes on at the start of *its* list; entries already met are
marked and not compared again.  A listed entry farther from the current one than twice the
query's distance cannot be nearer than it, nor as near, so the walk ends there.  All distances are
squared integers, hence results are exact, ties included.  ``WINDOW`` list places of each query are
looked at in one array step.

A round is one job over the integer table: tasks return sums and counts per entry and place, so
what is shuffled and what reaches the driver is bounded by the codebooks, whatever the input.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, and
so are those of another length than most (of lengths alike in number, the longest counts);
a length the parts do not divide raises, and so does a component too large for exact 64-bit
distances (beyond 65,536 for parts of up to 127 places); fewer vectors than entries make smaller
codebooks; null ids come after all others; rows that share an id are ordered by their vectors and
each has its row in the result; repeated rows count as often as they occur; an empty table gives
no rows.  Other columns of any name are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: List places looked at in one step, entries a search compares first, queries of one array step.
WINDOW, PROBES, QUERIES = 16, 16, 4096


class Orchard:
    """Exact nearest entry of one codebook (``m`` rows of integers)."""

    def __init__(self, entries: np.ndarray):
        self.m, self.width = entries.shape
        self.entries = entries.astype(np.int64)
        self.largest = int(np.abs(entries).max(initial=0))
        self._kind(self.largest)
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in self.entries])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.far = np.take_along_axis(apart, self.order, axis=1)
        # A list ends in entries that no walk goes beyond.
        self.order = np.pad(self.order, ((0, 0), (0, WINDOW)))
        self.far = np.pad(self.far, ((0, 0), (0, WINDOW)), constant_values=np.iinfo(np.int64).max)

    def _kind(self, largest: int) -> type:
        """The integer type in which all distances are exact."""
        bound = 4 * self.width * (2 * largest) ** 2
        if bound >= 1 << 63:
            raise ValueError("components are too large for exact 64-bit distances")
        return np.int32 if bound < 1 << 31 else np.int64

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, ties to the lower index."""
        kind = self._kind(max(self.largest, int(np.abs(queries).max(initial=0))))
        self.entries = self.entries.astype(kind, copy=False)
        index, error = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for a in range(0, len(queries), QUERIES):
            index[a:a + QUERIES], error[a:a + QUERIES] = self._walk(queries[a:a + QUERIES].astype(kind))
        return index, error

    def _apart(self, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
        diff = queries - self.entries[entries]
        return np.einsum("ij,ij->i", diff, diff).astype(np.int64)

    def _walk(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        met = np.zeros((n, self.m), bool)
        best, near = np.full(n, self.m), np.full(n, np.iinfo(np.int64).max)
        for probe in np.unique(np.linspace(0, self.m - 1, min(PROBES, self.m)).astype(int)):
            d = self._apart(queries, np.full(n, probe))
            better = d < near
            best[better], near[better] = probe, d[better]
            met[:, probe] = True
        place, live = np.zeros(n, np.int64), np.arange(n)
        step = np.arange(WINDOW)
        while len(live):
            at = place[live, None] + step
            listed = self.order[best[live, None], at]
            inside = self.far[best[live, None], at] <= 4 * near[live, None]
            row, column = np.nonzero(inside & ~met[live[:, None], listed])
            query, entry = live[row], listed[row, column]
            met[query, entry] = True
            d = self._apart(queries[query], entry)
            # Of a query's new entries the nearest, then the lowest index.
            order = np.lexsort((entry, d, row))
            first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
            query, entry, d = query[first], entry[first], d[first]
            better = (d < near[query]) | ((d == near[query]) & (entry < best[query]))
            place[live] += WINDOW
            moved = query[better]
            best[moved], near[moved], place[moved] = entry[better], d[better], 0
            go = inside[:, -1] & (place[live] < self.m)
            go |= place[live] == 0  # jumped: walk the new entry's list from its start
            live = live[go]
        return best, near


def integer_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, width, raw``: integer components as little-endian 32-bit, written once."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            value = lists.flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(SCALE * value.astype(np.float64))
            if len(whole) and np.abs(whole).max() >= 1 << 26:
                raise ValueError("a component is too large for exact 64-bit distances")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            cut = np.append(0, np.cumsum(4 * size.astype(np.int64))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(whole.astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), raw], ["vec_id", "label", "width", "raw"])

    prepare(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = vectors.select(F.col(label_col).alias("label")).schema["label"].dataType.simpleString()
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    ints = materialize(rows.mapInArrow(run, f"vec_id long, label {kind}, width int, raw binary"), "integer-vectors")
    widths = ints.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return ints if widths is None else ints.where(F.col("width") == widths["width"])


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x places."""
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
    return flat.reshape(len(column), parts, len(flat) // max(1, len(column) * parts))


def first_books(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts x entries x places: the parts of the smallest ids (``entries`` rows on the driver)."""
    rows = ints.orderBy(F.col("vec_id").asc_nulls_last(), "raw").limit(entries).select("raw").toArrow()
    if not rows.num_rows:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(rows.column(0)[0].as_py()) // 4
    if width % parts:
        raise ValueError(f"{parts} equal parts of {width} components")
    return _matrix(rows.column(0).combine_chunks(), parts).transpose(1, 0, 2).astype(np.int64)


def moved_books(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of the parts they are nearest to."""
    parts, _, width = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        search = [Orchard(b) for b in books]
        for batch in batches:
            data = _matrix(batch.column(0), parts)
            for p in range(parts):
                index, _ = search[p].nearest(data[:, p])
                np.add.at(total[p], index, data[:, p].astype(np.int64))
                count[p] += np.bincount(index, minlength=len(books[p]))
        p, e, k = np.nonzero(np.repeat(count[:, :, None] > 0, width, axis=2))
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e, k])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "n", "s"])

    sums = (ints.select("raw").mapInArrow(run, "part int, entry int, place int, n long, s long").groupBy("part", "entry", "place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")))
    out = books.copy()
    for r in sums.collect():  # parts x entries x places at most
        out[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return out


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` moves, parts x entries x places."""
    books = first_books(ints, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved_books(ints, books)
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row: two hex digits a part, squared error."""
    parts = len(books)

    def run(batches):
        if not books.size:
            return
        search = [Orchard(b) for b in books]
        for batch in batches:
            data = _matrix(batch.column(2), parts)
            found = [search[p].nearest(data[:, p]) for p in range(parts)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    kind = ints.schema["label"].dataType.simpleString()
    return ints.select("vec_id", "label", "raw").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector a code stands for, in the scale of the input."""
    return np.concatenate([books[p][i] for p, i in enumerate(bytes.fromhex(code))]) / SCALE


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    ints = integer_table(vectors, id_col, vector_col, label_col)
    books = fit(ints, parts, entries, rounds)
    coded = materialize(encode(ints, books), "vector-codes")
    # Summed per task first: a label with a third of all rows is one row of a task.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
