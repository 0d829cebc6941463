"""The command-line runner on small staged files."""

import os
import tempfile

from conftest import SF001
from tessel.plans import staging
from tessel import cli
from tessel.plans import standins as si
from tessel.sources import sinks, workbook


def test_cli_jobs(spark):
    root = tempfile.mkdtemp(prefix="tessel-cli-")
    with open(os.path.join(root, "flights.csv"), "w") as fh:
        fh.write("Year,Dest,Origin,Reporting_Airline,FlightDate\n"
                 "2024,LAX,JFK,AA,2024-01-05\n2024,JFK,LAX,AA,2024-01-06\n2024,LAX,JFK,AA,bad\n")
    with open(os.path.join(root, "airports.csv"), "w") as fh:
        fh.write('1,"A","X","US","JFK",\\N,40.6,-73.7,1,\\N,\\N,\\N,"airport","t"\n'
                 '2,"B","Y","US","LAX",\\N,33.9,-118.4,1,\\N,\\N,\\N,"airport","t"\n')
    cli.main(["enrich-flights", "--flights", os.path.join(root, "flights.csv"),
              "--airports", os.path.join(root, "airports.csv"), "--out", os.path.join(root, "e")])
    assert spark.read.parquet(os.path.join(root, "e")).count() == 2
    with open(os.path.join(root, "m2.csv"), "w") as fh:
        fh.write("Extra,OriginStateName,FlightDate\n1,TX,2024-02-01\n2,TX,2024-02-01\n")
    with open(os.path.join(root, "m1.csv"), "w") as fh:
        fh.write("Extra,OriginStateName,FlightDate\n1,NY,2024-01-01\n")
    cli.main(["count-top-k", "--flights", os.path.join(root, "m*.csv"), "--k", "1",
              "--out", os.path.join(root, "top")])
    top = spark.read.option("header", True).csv(os.path.join(root, "top")).collect()
    assert [(r.FlightDate, r.OriginStateName, r.len) for r in top] == [("2024-02-01", "TX", "2")]

    staging.write_workbooks(si.customers(spark, SF001), os.path.join(root, "cust"))
    sinks.write_csv(si.order_items(spark, SF001).select("order_id", "order_item_id", "price"),
                    os.path.join(root, "items"))
    sinks.write_csv(si.orders(spark, SF001).drop("order_status"), os.path.join(root, "orders"))
    sinks.write_csv(si.geolocations(spark, SF001).orderBy("line_no").select(
        "geolocation_zip_code_prefix", "geolocation_state").coalesce(1), os.path.join(root, "geo"))
    staging.write_json_records(si.states(spark, SF001), os.path.join(root, "states"))
    cli.main(["consolidate-orders", "--orders", os.path.join(root, "orders"),
              "--items", os.path.join(root, "items"), "--customers", os.path.join(root, "cust"),
              "--geolocations", os.path.join(root, "geo"), "--states", os.path.join(root, "states"),
              "--out", os.path.join(root, "c")])
    out = spark.read.option("header", True).csv(os.path.join(root, "c"))
    assert out.count() == 1500 and "delay_status" in out.columns and "state" in out.columns
