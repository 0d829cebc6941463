"""Incremental flight enrichment with Structured Streaming.

New monthly CSV files landing in a folder are enriched as they arrive: the
same row-level plan as the batch job (lenient date parse, two left joins
with the static airport dimension, not-null filter) runs per micro-batch,
and the file sink with its checkpoint in the shared folder makes the output
exactly-once across restarts and lost executors.  A watermarked tumbling
window gives live daily counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.plans import flights as fl


def read_flight_files(spark: SparkSession, folder: str, schema, max_files_per_trigger: int = 0,
                      header: bool = True) -> DataFrame:
    """A streaming DataFrame over the CSV files of ``folder`` (new files are picked up)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = (spark.readStream.schema(schema).option("header", header)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(folder)


def enrich_stream(flights_stream: DataFrame, airports: DataFrame,
                  date_format: str | None = None) -> DataFrame:
    """Stream-static form of :func:`tessel.plans.flights.enrich_flights`.

    No broadcast hint: it would outlive the size check while the dimension grows; each
    micro-batch's planner decides from the dimension's current size."""
    return fl.enrich_flights(flights_stream, airports, date_format, broadcast_max_rows=None)


def run_enrichment(flights_stream: DataFrame, airports: DataFrame, out_path: str,
                   checkpoint: str, available_now: bool = True, trigger_seconds: int = 60):
    """Write the enriched stream as parquet partitioned by year and month.

    ``available_now`` processes what is there and stops (a scheduled
    incremental run); otherwise the query keeps running with a processing-time
    trigger.  Returns the started :class:`StreamingQuery`.
    """
    writer = (enrich_stream(flights_stream, airports).writeStream.format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint)
              .partitionBy(*fl.MONTH).outputMode("append"))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=f"{trigger_seconds} seconds"))
    return writer.start()


def daily_counts_stream(enriched_stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """AGG3 live: flights per calendar day with a watermark of ``lateness``.

    Rows ``(FlightDate, vuelos)``; in append mode a day is emitted once the
    watermark passes its end, and state for older days is dropped.
    """
    # event time = the UTC-midnight instant of the date, so day windows are calendar days
    # whatever the session time zone
    ts = F.timestamp_seconds(F.unix_date(F.col("FlightDate")).cast("bigint") * 86400)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return (enriched_stream.withColumn("_t", ts).withWatermark("_t", lateness)
            .groupBy(F.window("_t", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("vuelos"))
            .select(day.alias("FlightDate"), "vuelos"))


def enriched_output(spark: SparkSession, out_path: str) -> DataFrame:
    """The sink folder read back as a batch table, columns in the batch job's order."""
    df = spark.read.parquet(out_path)
    return df.select(*fl.ENRICHED_COLUMNS)


def stage_layout(root: str) -> dict:
    """Folders of one incremental pipeline under ``root`` (input, output, checkpoint)."""
    return {k: os.path.join(root, k) for k in ("input", "output", "checkpoint")}
