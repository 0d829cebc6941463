"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import materialize, shared_dir, ship_package

#: Bytes of one Arrow batch handed to a Python worker; bounds a worker's memory on long texts.
BATCH_BYTES = 4 * 1024 * 1024


def release() -> None:
    """Hand freed memory back to the system: allocators keep it, and a worker that Spark keeps would
    hold it beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries lack it
        trim(0)


_DROPS: dict = {}
_owner = [None]


def claim(owner: str, drop) -> None:
    """Called by an operator's code in a worker: ``drop`` empties its caches when another operator
    takes over the process, which Spark keeps from job to job."""
    _DROPS[owner] = drop
    if _owner[0] != owner:
        _owner[0] = owner
        for name, other in _DROPS.items():
            if name != owner:
                other()
        release()


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and bound their Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null as empty) and its ``n + 1`` offsets into them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def clean_utf8(array: pa.Array) -> pa.Array:
    """The strings with every invalid byte sequence replaced by U+FFFD; nulls stay.  Spark keeps
    the bytes of a text as they were read, so they need not be valid UTF-8."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    try:
        return array.cast(pa.binary()).cast(pa.string())  # this cast validates
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in array.cast(pa.binary()).to_pylist()], pa.string())


def runs(offsets: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes each (a longer row is a range of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


__all__ = ["BATCH_BYTES", "claim", "clean_utf8", "col", "free_name", "materialize", "prepare", "release", "runs", "shared_dir", "table", "utf8"]
