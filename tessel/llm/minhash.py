"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch.  A document's set of five-word shingles is placed into ``COORDINATES`` bins in rounds:
in round i every shingle draws a bin and a value; a bin keeps its least (round, value).  Rounds
stop when all bins are full; after ``COORDINATES`` such rounds, round COORDINATES + j sends every
shingle to bin j, so each coordinate fills in bounded time, with the concentration of independent
min-hashes.  Sets alike in a share J of their union agree in each coordinate with probability J.

Banding.  ``BANDS`` keys of ``ROWS`` coordinates each; sets meet if one key is equal.  At the
threshold a pair fails to meet with probability (1 - 0.85**6)**42 = 3e-9 at 85 percent and
(1 - 0.8**6)**42 = 3e-6 at 80.

Verification never samples and never lists all pairs of a bucket:
 1. equal sets are one representative (smallest doc_id);
 2. every member of a bucket is compared, on full sets, with the bucket's most central member;
    links found so contract to components;
 3. members of buckets that still hold several components get an exact prefix filter: tokens in
    one global order (rarest first), pairs of different components that share a prefix token and
    whose positions still allow the threshold are compared on full sets.  Any linked pair shares
    such a token, so nothing is lost; a token's largest component is met only by rows outside it, so
    a linked crowd costs its size, and near-copy crowds under the threshold share no such token.

Defined cases: words are runs of other than ASCII white space, A-Z lower-cased; fewer than five
words make one shingle; null, empty or blank texts have an empty set, link with nothing and stay;
a null doc_id gets a null component and stays; rows that share a doc_id are one document (linked
if any of its sets is); exact copies are linked.  Sets are held as 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, col, free_name, materialize, prepare, release, runs, utf8
from .components import components

WORDS = 5
BANDS, ROWS = 42, 6
COORDINATES = BANDS * ROWS
#: Links: 100 * intersection >= percent * union; this is the default.
PERCENT = 85

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    claim("minhash", _WORDS.clear)
    known = _WORDS
    h = np.fromiter([known[w] for w in words], np.uint64, len(words))
    k = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            acc += _mix(h[i:len(h) - k + 1 + i] ^ _ODD[i]) * _ODD[i]
        return np.unique(_mix(acc))


def sketches(items: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates for each non-empty set; sets lie end to end in ``items``."""
    n = len(offsets) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    live, low = items, np.uint64(np.iinfo(np.uint64).max >> 9)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(live):
                break
            h = _mix(live + np.uint64(i + 1) * _ODD[0])
            place = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(live), i - t)
            value = (np.uint64(i) << np.uint64(55)) | (_mix(h ^ _ODD[1]) & low)
            np.minimum.at(out, owner * t + place, value)
            if i < 8 or i % 8 == 7:
                full = (out.reshape(n, t).max(axis=1) >> np.uint64(55)) <= i
                keep = ~full[owner]
                live, owner = live[keep], owner[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """``BANDS`` 64-bit keys of each row; a key carries its band's number."""
    with np.errstate(over="ignore"):
        acc = np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[2] + np.zeros((len(sketch), 1), np.uint64)
        part = sketch.reshape(len(sketch), BANDS, ROWS)
        for r in range(ROWS):
            acc = _mix(acc + part[:, :, r] * _ODD[r % 5])
    return acc


def _chunks(offsets: np.ndarray):
    """Ranges of at most 256 rows and about half a megabyte."""
    for a, b in runs(offsets, 500_000):
        for x in range(a, b, 256):
            yield x, min(x + 256, b)


SKETCH = "doc_id long, n_shingles long, set_id string, bands array<long>"


def _sketch_batches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        raw = data.tobytes()
        for a, b in _chunks(offsets):
            cut = offsets[a:b + 1].tolist()
            sets = [shingle_set(raw[x:y]) for x, y in zip(cut, cut[1:])]
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            keys = np.zeros((len(sets), BANDS), np.uint64)
            if len(some):
                keys[some] = band_keys(sketches(np.concatenate([sets[i] for i in some]), np.append(0, np.cumsum(size[some]))))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            ids = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(size), pa.array(ids, pa.string()), bands],
                                             ["doc_id", "n_shingles", "set_id", "bands"])
    release()  # the worker stays


SETS = "node long, size long, tokens array<long>"


def _set_batches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        raw = data.tobytes()
        for a, b in _chunks(offsets):
            cut = offsets[a:b + 1].tolist()
            sets = [shingle_set(raw[x:y]) for x, y in zip(cut, cut[1:])]
            ends = np.append(0, np.cumsum([len(s) for s in sets]))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                             ["node", "size", "tokens"])
    release()


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingle sets of the documents named in ``nodes (node)``."""
    wanted = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(_set_batches, SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    close = (100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb"))
    sized = (pairs.join(sets.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b").where(close).select("a", "b").distinct())
    return (sized.join(right, "b").join(left, "a")
            .where((100 + percent) * both >= percent * (F.col("sa") + F.col("sb"))).select("a", "b").distinct())


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Prefix tokens of each set with their place ``at`` (from 1) in one global order: by the
    number of sets that hold a token, then by the token.  Tokens of one set only come first and
    match nothing, so they are counted, not listed.  ``sets (node, component, size, tokens)``."""
    own = ["node", "component", "size", "sid"]
    tokens = sets.withColumn("sid", F.xxhash64("tokens")).select(*own, F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = tokens.join(often, "token").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("l"))
    unique = F.col("size") - F.size("l")
    longest = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    kept = F.slice("l", 1, F.greatest(F.lit(0), longest - unique).cast("int"))
    return (ordered.select("node", "component", "size", unique.alias("unique"), F.posexplode(kept).alias("pos", "t"))
            .select("node", "component", "size", F.col("t.token").alias("token"), (F.col("unique") + F.col("pos") + 1).alias("at")))


def token_meetings(held: DataFrame) -> DataFrame:
    """Rows of ``held (node, component, size, token, at)`` met over a token that several components
    hold: every row outside the token's largest component with all rows of the token.  A pair of
    different components has an end outside that one, so none is lost, and a crowd that is one
    component is never met with itself."""
    crowds = held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    main = (crowds.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
            .select("token", F.col("m.component").alias("main")))
    shared = held.join(main, "token")
    outside = shared.where("component <> main").select(F.col("node").alias("a"), F.col("component").alias("ca"), F.col("size").alias("sa"), "token", F.col("at").alias("pa"))
    return outside.join(shared.select(F.col("node").alias("b"), F.col("component").alias("cb"), F.col("size").alias("sb"), "token", F.col("at").alias("pb")), "token")


def prefix_pairs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components that an exact prefix and position filter leaves."""
    met = token_meetings(materialize(prefixes(sets, percent), "prefixes"))
    low, high = F.least("sa", "sb"), F.greatest("sa", "sb")
    # The smaller set of a pair needs a shorter prefix: its least overlap with any larger set.
    a_small = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    shorter = low - F.ceil(F.lit(2 * percent) * low / (100 + percent)) + 1
    reach = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) + 1
    allowed = ((F.col("ca") != F.col("cb")) & (F.when(a_small, F.col("pa")).otherwise(F.col("pb")) <= shorter)
               & (100 * low >= percent * high) & ((100 + percent) * reach >= percent * (F.col("sa") + F.col("sb"))))
    return met.where(allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def repeated(rows: DataFrame) -> bool:
    """Whether a doc_id occurs in more than one row."""
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return not ids.where("n > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketch_batches, SKETCH), "sketch")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    again = repeated(real)
    if again:
        docs = docs.dropDuplicates(["doc_id", "text"])
    # Equal sets: one representative, copies collapsed before the shuffle.
    reps = (real.groupBy("set_id").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
            .select("set_id", F.col("r.doc_id").alias("node"), F.col("r.bands").alias("bands")))
    reps = materialize(reps, "representatives")
    entries = reps.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(entries.join(buckets, "key"), "buckets")
    # The most central member of a bucket: the one whose buckets hold the most members.
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    lead = (shared.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("o"))).alias("m"))
            .select("key", (-F.col("m.o")).alias("lead")))
    stars = materialize(shared.join(lead, "key").where("node <> lead")
                        .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "pairs")
    sets = materialize(full_sets(docs, shared.select("node")), "sets")
    links = materialize(verified(stars, sets, percent), "links")
    found = materialize(components(links), "components")
    # Buckets of three or more that still hold several components: exact prefix filter.
    where = F.coalesce("component", "node")
    labelled = shared.where("n > 2").join(found, "node", "left").select("key", "node", where.alias("component"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = materialize(labelled.join(open_, "key", "left_semi").select("node", "component").distinct(), "open")
    pairs = materialize(prefix_pairs(materialize(sets.join(rest, "node"), "open-sets"), percent), "pairs")
    all_links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(pairs, sets, percent))
    # Rows that share a doc_id are one document: its sets' representatives are linked too.
    if again:
        own = real.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id")
        same = real.join(own, "doc_id", "left_semi").join(reps.select("set_id", "node"), "set_id")
        all_links = all_links.union(same.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")))
    final = components(all_links)
    node_of = reps.select("set_id", "node").join(final, "node", "left").select("set_id", where.alias("component_id"))
    linked = real.join(node_of, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (where an id has
    several rows, the least row by text and the other columns).  Rows without an id stay."""
    groups = materialize(near_duplicates(docs, id_col, text_col, percent), "groups")
    name = free_name(docs, "gone")
    gone = groups.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
    if not repeated(groups):
        return left
    row = F.struct(text_col, *[col(docs, c) for c in docs.columns if c != text_col])
    once = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).agg(F.min(row).alias("row"))
    return left.where(F.col(id_col).isNull()).unionByName(once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
