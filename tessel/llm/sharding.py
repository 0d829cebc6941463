"""Sharding by fixed virtual slots.

Every record hashes into one of ``slots`` virtual slots.  Bytes and rows are aggregated per
slot; a small versioned table maps slots to shards.  Version 1 deals the slots round robin;
rebalancing loads the newest version, edits it (moves whole slots) and appends the next one; it
never rehashes a record.

Law: ``bytes``.  The edited map's shard sizes differ by at most about one small record, unless
one record alone is larger than a shard's share.

Defined cases: a null text counts as empty (size 1); null ids are allowed, the hash takes id,
size and checksum, so rows without an id spread over the slots; repeated rows are counted and cut
into chunks of at most a fraction of a slot's mean bytes (at least one row), each of which hashes
into a slot of its own, so a record that holds a third of all rows spreads too; an empty table
gives no rows and an even map; a map of more shards than wanted has the others' slots dealt out.  The
map and the per-slot sums have ``slots`` rows whatever the input, so the driver edits them and
the join broadcasts them.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.session import materialize, shared_dir

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int"


#: Chunks of copies hold at most the bytes of a slot's mean divided by this.
CHUNKS_OF_SLOT = 4


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (id, size, checksum) with their number ``copies``."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    return slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def chunked(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Records with their copies cut into chunks, and each chunk's virtual slot.  All records
    together make at most ``slots * CHUNKS_OF_SLOT`` chunks more than there are records."""
    total = recs.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    most = F.greatest(F.lit(1), F.floor(F.lit(total // (slots * CHUNKS_OF_SLOT)) / F.col("size"))).cast("long")
    last = F.floor((F.col("copies") - 1) / most).cast("long")
    parts = recs.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "chunk"), F.lit(slots)).cast("int")
    return parts.select("doc_id", "size", "text_crc32", "chunk", F.least("most", F.col("copies") - F.col("chunk") * F.col("most")).alias("copies"), slot.alias("virtual_slot"))


def slot_sums(recs: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has rows."""
    return recs.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 1: slots dealt round robin."""
    return np.arange(slots) % shards


def rebalance(shard_of: np.ndarray, size: np.ndarray, shards: int, most_edits: int = 4000) -> np.ndarray:
    """An edited map whose shard sums are nearly equal; slots that need not move stay.

    Overfull shards give up their largest slots that fit above the mean; these go, largest
    first, to the emptiest shard; then moves and swaps between the fullest and the emptiest
    shard go on while they lower the difference.
    """
    out = np.asarray(shard_of).copy()
    size = np.asarray(size, np.int64)
    pool = np.flatnonzero(out >= shards).tolist()  # shards that are no more
    mean = size.sum() / shards
    load = np.bincount(out[out < shards], size[out < shards], shards).astype(np.int64)
    for k in np.flatnonzero(load > mean):
        own = np.flatnonzero(out == k)
        for s in own[np.lexsort((own, -size[own]))]:
            if size[s] and load[k] - size[s] >= mean:
                load[k] -= size[s]
                pool.append(int(s))
    heap = [(int(load[k]), k) for k in range(shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-size[s], s)):
        least, k = heapq.heappop(heap)
        out[s] = k
        load[k] = least + size[s]
        heapq.heappush(heap, (int(load[k]), k))
    for _ in range(most_edits):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap < 2:
            break
        a, b = np.flatnonzero((out == hi) & (size > 0)), np.flatnonzero((out == lo) & (size > 0))
        b = b[np.argsort(size[b], kind="stable")]
        give = np.append(0, size[b])  # nothing, or one slot, comes back
        best = (gap, -1, -1)
        for s in a:
            i = int(np.searchsorted(give, size[s] - gap / 2))
            for j in (i - 1, i):
                if 0 <= j < len(give):
                    left = abs(gap - 2 * (size[s] - give[j]))
                    if left < best[0]:
                        best = (left, int(s), j - 1)
        if best[1] < 0:
            break
        _, s, j = best
        out[s] = lo
        load[hi], load[lo] = load[hi] - size[s], load[lo] + size[s]
        if j >= 0:
            out[b[j]] = hi
            load[hi], load[lo] = load[hi] + size[b[j]], load[lo] - size[b[j]]
    return out


def grow(shard_of: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The map edited for one more shard: slots move only into the new one, each from the shard
    that is then the fullest, until it holds its share of the bytes (of the slots when all are empty)."""
    out = np.asarray(shard_of).copy()
    size = np.asarray(size, np.int64)
    if not size.any():
        size = np.ones_like(size)
    load = np.bincount(out, size, shards).astype(np.int64)
    share, new = size.sum() / (shards + 1), 0
    own = {k: sorted(np.flatnonzero(out == k).tolist(), key=lambda s: (size[s], s)) for k in range(shards)}
    while new < share:
        k = int(load.argmax())
        fits = [s for s in own[k] if 0 < size[s] <= 2 * (share - new)]
        if not fits:
            break
        s = fits[-1]
        own[k].remove(s)
        out[s] = shards
        load[k] -= size[s]
        new += size[s]
    return out


def newest(spark: SparkSession, path: str) -> tuple[int, np.ndarray | None]:
    """Number and slots of the newest stored version; 0 and nothing if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0, None
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        return 0, None
    rows = stored.where(F.col("version") == version).orderBy("slot").collect()  # a row per slot
    return version, np.array([r["shard"] for r in rows])


def store(spark: SparkSession, versions: list[np.ndarray], path: str | None = None, first: int = 1) -> str:
    """Append the versions, numbered from ``first``, to the stored map (a new folder in shared
    storage by default)."""
    path = path or shared_dir(spark, "slot-map")
    rows = [(v, int(s), int(k)) for v, m in enumerate(versions, first) for s, k in enumerate(m)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One version of the stored map."""
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per document: size, checksum, shard, gapless position in the shard, virtual slot.

    ``map_path`` holds the versions of the slot map: the newest one is edited for these documents
    and the edited one appended (a first one is dealt if there is none, or none of so many slots).
    Without a path the map lives in a folder of its own."""
    spark = docs.sparkSession
    recs = materialize(chunked(materialize(records(docs, id_col, text_col), "shard-records"), slots), "shard-chunks")
    sums = {r["virtual_slot"]: r["bytes"] for r in slot_sums(recs).collect()}  # at most `slots` rows
    size = np.array([sums.get(s, 0) for s in range(slots)], np.int64)
    version, known = newest(spark, map_path) if map_path else (0, None)
    fresh = known is None or len(known) != slots
    before = first_map(shards, slots) if fresh else known
    edited = rebalance(before, size, shards)
    path = store(spark, [before, edited] if fresh else [edited], map_path, version + 1)
    stored = load(spark, path, version + (2 if fresh else 1)).withColumnRenamed("slot", "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (stored.join(slot_sums(recs), "virtual_slot")  # at most `slots` rows
              .withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
              .select("virtual_slot", "shard", "offset", F.col("version").alias("map_version")))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (recs.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
            .join(F.broadcast(placed), "virtual_slot")
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("first") + F.col("copy")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"))
