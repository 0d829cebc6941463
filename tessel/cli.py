"""Run the file-based jobs from the command line (``spark-submit`` or ``python -m``).

    python -m tessel.cli count-top-k --flights 'monthly/*.csv' --k 30 --out OUT
    python -m tessel.cli enrich-flights --flights 'monthly/*.csv' --airports airports.csv --out OUT
    python -m tessel.cli consolidate-orders --orders o.csv --items i.csv --customers cust/ \\
        --geolocations g.csv --states s.json --out OUT

Outputs are parquet folders (the enriched flights partitioned by year and month), and a
CSV folder for the top-k counts.
"""

from __future__ import annotations

import argparse

from tessel.plans import flights as fl
from tessel.plans import orders as od
from tessel.session import get_session
from tessel.sources import files, sinks, workbook

FLIGHT_COLUMNS = "FlightDate string, Reporting_Airline string, Origin string, Dest string"
ORDER_COLUMNS = "order_id string, customer_id string, " + ", ".join(
    f"{c} string" for c in od.TIMESTAMP_COLUMNS)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tessel")
    sub = ap.add_subparsers(dest="job", required=True)
    e = sub.add_parser("enrich-flights")
    e.add_argument("--flights", required=True, help="CSV file(s), folder or glob, with header")
    e.add_argument("--airports", required=True, help="headerless airport list, \\N = missing")
    e.add_argument("--out", required=True)
    t = sub.add_parser("count-top-k")
    t.add_argument("--flights", required=True, help="CSV file(s), folder or glob, with header")
    t.add_argument("--k", type=int, default=30)
    t.add_argument("--out", required=True, help="CSV output folder (one part file)")
    c = sub.add_parser("consolidate-orders")
    for name in ("orders", "items", "customers", "geolocations", "states", "out"):
        c.add_argument(f"--{name}", required=True)
    ap.add_argument("--format", choices=("csv", "parquet"), default="csv",
                    help="output of consolidate-orders")
    ap.add_argument("--master", default=None, help="e.g. local[*]; unset on a cluster")
    args = ap.parse_args(argv)

    spark = get_session(args.master)
    if args.job == "count-top-k":
        raw = files.read_csv(spark, args.flights, "FlightDate string, OriginStateName string",
                             by_name=True)
        # a top-k result is small: one CSV part file, as the original single output file
        sinks.write_csv(fl.count_top_k(raw, k=args.k), args.out, single_file=True)
    elif args.job == "enrich-flights":
        raw = files.read_csv(spark, args.flights, FLIGHT_COLUMNS, by_name=True)
        airports = fl.load_airports(files.read_airports(spark, args.airports))
        fl.write_enriched(fl.enrich_flights(raw, airports), args.out)
    else:
        orders = files.read_csv(spark, args.orders, ORDER_COLUMNS, by_name=True)
        items = files.read_csv(spark, args.items,
                               "order_id string, order_item_id int, price double", by_name=True)
        customers = workbook.read_workbooks(
            spark, args.customers, "customer_id string, customer_zip_code_prefix string")
        geo = files.read_csv(spark, args.geolocations,
                             "geolocation_zip_code_prefix string, geolocation_state string",
                             by_name=True)
        # file order of the geolocation rows decides which one is kept per zip prefix
        geo = geo.withColumn("line_no", _file_order())
        states = files.read_json_records(spark, args.states, "abbreviation string, state string")
        out = od.consolidate_orders(orders, items, customers, geo, states)
        if args.format == "csv":
            sinks.write_csv(out, args.out)
        else:
            sinks.write_parquet(out, args.out)


def _file_order():
    """Order of rows in their files: file path, then position within the file's splits."""
    from pyspark.sql import functions as F

    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                    F.monotonically_increasing_id())


if __name__ == "__main__":
    main()
