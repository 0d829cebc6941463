"""Session defaults and the shared scratch location.

Defaults: adaptive query execution with skew-join splitting and partition
coalescing, UTC session time zone (the jobs treat timestamps as wall-clock
values, like the pandas code they replace), Arrow transfer for the few
pandas boundaries, and no web UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for very large inputs (tens of TB on hundreds of executors): big file splits
# and shuffle partitions sized by AQE from a large initial count, so each task handles a
# few hundred MB and shuffles spread over the whole cluster; skewed partitions (a key
# with a third of the rows) are split by AQE's skew join.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def get_session(master: str | None = None, app_name: str = "tessel",
                shuffle_partitions: int | None = None,
                conf: dict | None = None, cluster: bool = False) -> SparkSession:
    """Return the active session or build one with the defaults above.

    On a cluster ``master`` stays ``None`` so the launcher decides and
    ``cluster=True`` adds :data:`CLUSTER_CONF`; tests pass ``local[*]`` and a
    small ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if cluster:
        settings.update(CLUSTER_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used.  Only when nothing is configured and
    the master is local (unit tests on one machine) is a temporary folder created
    and registered, so that ``DataFrame.checkpoint()`` works there too; on a
    cluster an unset folder raises, since executors do not share local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder under the shared checkpoint root.

    Used for written intermediate tables and for the staged inputs of the
    source round-trip jobs; never a machine-local path on a cluster.
    """
    root = checkpoint_root(spark)
    return os.path.join(root, "tessel", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str = "table"):
    """Cut the lineage of a table that several later steps read.

    The table is written as parquet to a fresh folder under the shared
    checkpoint root and read back: later reads do not re-run its plan, a lost
    executor does not force recomputation from the sources, and the planner
    sees the table's real size (so a small result can be broadcast safely).
    The folder lives as long as the application and is deleted when it ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Operators that run Python in tasks (workbook and zip readers, JSON-array
    and workbook writers, the custom-colour pandas UDF) need the package on
    the workers.  When it is not installed there, an archive of it is handed
    to ``SparkContext.addPyFile``, which distributes it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="tessel-pyfiles-")
    archive = os.path.join(out_dir, "tessel.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
