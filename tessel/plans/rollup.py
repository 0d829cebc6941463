"""The route table by month, kept up to date file by file (AGG1, SNK6, LAY1).

The table is partitioned by year and month.  A manifest beside it says which input files it was
computed from (path, length, time) and which months each of them held.  A refresh reads only the
date column of new and changed files, to learn their months; recomputes the months that these, or
vanished files, take part in, from all files that hold such a month; and replaces just those
partitions (dynamic overwrite).  Other partitions' files are not touched.

The manifest is written last: a refresh that is interrupted is simply done again, since replacing a
partition twice gives the same partition.  Driver-side data: an entry per input file and its months.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import dates
from tessel.plans import flights as fl
from tessel.session import materialize
from tessel.sources import manifest as mf


def _months(raw: DataFrame) -> dict[str, list[list[int]]]:
    """Months of every input file of ``raw`` (a row per file and month)."""
    day = dates.parse_date("FlightDate")
    rows = (raw.select(F.input_file_name().alias("file"), dates.year(day).alias("y"), dates.month(day).alias("m"))
            .where("y IS NOT NULL").distinct().collect())
    out: dict[str, list[list[int]]] = {}
    for r in rows:
        out.setdefault(_plain(r["file"]), []).append([r["y"], r["m"]])
    return {k: sorted(v) for k, v in out.items()}


def _plain(path: str) -> str:
    """One spelling of a path: Spark encodes input file names and writes file:///."""
    from urllib.parse import unquote

    path = unquote(path)
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def refresh(spark: SparkSession, folder: str, out: str, airports: DataFrame, read: Callable[[list[str]], DataFrame],
            suffix: str = ".csv", key: str = "") -> dict:
    """Bring the route table at ``out`` up to date with the flight files under ``folder``.

    ``read`` turns a list of paths into the raw flight table (``FlightDate``, ``Reporting_Airline``,
    ``Origin``, ``Dest``).  ``key`` names everything else that decides the result (the version of
    the airport list, say): another key than the stored one makes every file new.  Returns the
    numbers of new or changed and of vanished files, and the months recomputed.
    """
    stored = mf.load(spark, f"{out}/manifest.json")
    now = {_plain(p): v for p, v in mf.list_inputs(spark, folder, suffix).items()}
    known = stored.get("files", {})
    same = {p for p, v in now.items() if known.get(p, {}).get("state") == v and stored.get("key") == key}
    fresh, gone = sorted(set(now) - same), sorted(set(known) - set(now))
    found = _months(read(fresh)) if fresh else {}
    months = {p: known[p]["months"] if p in same else found.get(p, []) for p in now}
    touched = {tuple(m) for p in fresh for m in months[p]} | {tuple(m) for p in known if p not in same for m in known[p]["months"]}
    if touched:
        live = set()
        sources = sorted(p for p, ms in months.items() if touched & {tuple(m) for m in ms})
        if sources:
            chosen = (F.col("Year") * 100 + F.col("Month")).isin([100 * y + m for y, m in sorted(touched)])
            table = materialize(fl.route_counts(fl.enrich_flights(read(sources), airports).where(chosen)), "rollup")
            live = {(r["Year"], r["Month"]) for r in table.select("Year", "Month").distinct().collect()}
            (table.repartition("Year", "Month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("Year", "Month").parquet(f"{out}/routes"))
        for y, m in touched - live:  # months without flights now
            mf.delete(spark, f"{out}/routes/Year={y}/Month={m}")
    if fresh or gone or not stored:
        mf.store(spark, f"{out}/manifest.json", {"key": key, "files": {p: {"state": now[p], "months": months[p]} for p in now}})
    return {"fresh": len(fresh), "gone": len(gone), "months": sorted(touched)}


ROUTES = ("IATA_ORIGIN string, OriginLat double, OriginLon double, IATA_DEST string, DestLat double, DestLon double, "
          "AIRLINE string, total bigint, color string, Year int, Month int")


def routes(spark: SparkSession, out: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """The route table, or one month of it (partition pruning)."""
    df = spark.read.schema(ROUTES).parquet(f"{out}/routes") if mf.exists(spark, f"{out}/routes") else spark.createDataFrame([], ROUTES)
    return fl.select_month(df, year, month).select("Year", "Month", *fl.ROUTE_KEYS, "total", "color")
