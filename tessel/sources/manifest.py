"""What a folder of input files held when a result was computed from it (SNK6).

A manifest is a list of (path, length, time) from Hadoop's file system, so it works wherever Spark
reads.  Results keep the manifest they were computed from; comparing it with the present one tells
whether they still hold, and which files are new, changed or gone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_inputs(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, list[int]]:
    """``{path: [length, time]}`` of the files under ``folder`` (an entry per input file)."""
    fs, root = _fs(spark, folder)
    out: dict[str, list[int]] = {}
    if not fs.exists(root):
        return out
    found = fs.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toString()
        if path.endswith(suffix) and not any(x[:1] in "._" for x in path[len(root.toString()):].split("/") if x):
            out[path] = [f.getLen(), f.getModificationTime()]
    return out


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def load(spark: SparkSession, path: str) -> dict:
    """The stored document, or an empty one."""
    if not exists(spark, path):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()) or "{}")


def store(spark: SparkSession, path: str, document: dict) -> None:
    """Written to a draft first and then renamed, so a reader meets the old or the new one."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, draft = _fs(spark, path + ".draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(document).encode()))
    stream.close()
    fs.delete(p, True)
    fs.rename(draft, p)


def keep_for(spark: SparkSession, inputs: dict, path: str, build) -> DataFrame:
    """SNK6: the table at ``path`` if it was computed from the same ``inputs`` (a manifest, and
    anything else that decides the result, as JSON), else ``build()`` written there."""
    key = json.loads(json.dumps(inputs))
    mark = f"{path}/key.json"
    stored = load(spark, mark)
    if "key" not in stored or stored["key"] != key:
        delete(spark, mark)  # a half-written table must not pass for the old one
        build().write.mode("overwrite").parquet(f"{path}/data")
        store(spark, mark, {"key": key})
    return spark.read.parquet(f"{path}/data")
