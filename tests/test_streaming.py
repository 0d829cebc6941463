"""Structured Streaming: incremental enrichment equals the batch job; watermarked daily counts."""

import os
import tempfile

from conftest import SF001, rows
from tessel.plans import flights as fl
from tessel.plans import standins as si
from tessel.sources import sinks
from tessel.streaming import flights as sf

SCHEMA = ("FlightDate string, Reporting_Airline string, Flight_Number_Reporting_Airline int, "
          "Origin string, OriginStateName string, Dest string, Distance double")


def test_incremental_enrichment_matches_batch_and_restarts(spark):
    lay = sf.stage_layout(tempfile.mkdtemp(prefix="tessel-stream-"))
    flights = si.flights(spark, SF001)
    airports = fl.load_airports(si.airports(spark, SF001))
    first, second = flights.randomSplit([0.5, 0.5], seed=1)
    sinks.write_csv(first.repartition(3), os.path.join(lay["input"], "m1"))
    stream = sf.read_flight_files(spark, os.path.join(lay["input"], "*"), SCHEMA,
                                  max_files_per_trigger=1)
    sf.run_enrichment(stream, airports, lay["output"], lay["checkpoint"]).awaitTermination()
    n1 = sf.enriched_output(spark, lay["output"]).count()
    # a new month arrives; the restarted query processes only the new files
    sinks.write_csv(second.repartition(2), os.path.join(lay["input"], "m2"))
    stream = sf.read_flight_files(spark, os.path.join(lay["input"], "*"), SCHEMA)
    sf.run_enrichment(stream, airports, lay["output"], lay["checkpoint"]).awaitTermination()
    got = sf.enriched_output(spark, lay["output"])
    want = fl.enrich_flights(flights, airports)
    assert n1 < got.count() == want.count()
    assert rows(got) == rows(want)


def test_watermarked_daily_counts(spark):
    lay = sf.stage_layout(tempfile.mkdtemp(prefix="tessel-stream-"))
    flights = si.flights(spark, SF001)
    sinks.write_csv(flights, lay["input"])
    airports = fl.load_airports(si.airports(spark, SF001))
    enriched = sf.enrich_stream(sf.read_flight_files(spark, lay["input"], SCHEMA), airports)
    q = (sf.daily_counts_stream(enriched, "100000 days").writeStream.outputMode("complete")
         .format("memory").queryName("daily_counts_test").trigger(availableNow=True)
         .option("checkpointLocation", lay["checkpoint"]).start())
    q.awaitTermination()
    got = rows(spark.sql("SELECT FlightDate, vuelos FROM daily_counts_test"))
    want = rows(fl.daily_series(fl.enrich_flights(flights, airports)))
    assert got == want
