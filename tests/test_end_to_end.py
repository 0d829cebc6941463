"""Workloads run from files, as a user would: readers -> job -> writers, checked with pandas."""

import os
import tempfile

import pandas as pd

from conftest import SF001
from tessel.plans import staging
from tessel.plans import flights as fl
from tessel.plans import orders as od
from tessel.plans import standins as si
from tessel.sources import files, sinks, workbook

FLIGHT_SCHEMA = ("FlightDate string, Reporting_Airline string, "
                 "Flight_Number_Reporting_Airline int, Origin string, OriginStateName string, "
                 "Dest string, Distance double")


def test_flights_from_files_to_month_dashboard(spark):
    root = tempfile.mkdtemp(prefix="tessel-e2e-")
    # monthly flight files and the headerless airport list with \N for missing values
    flights = si.flights(spark, SF001)
    sinks.write_csv(flights, os.path.join(root, "flights"))
    air = si.airports(spark, SF001).toPandas()
    lines = []
    for r in air.itertuples(index=False):
        lat = "\\N" if pd.isna(r.Latitude) else repr(r.Latitude)
        lon = "\\N" if pd.isna(r.Longitude) else repr(r.Longitude)
        lines.append(f'{r.AirportID},"{r.Name}","{r.City}","{r.Country}","{r.IATA}",\\N,'
                     f'{lat},{lon},0,\\N,\\N,\\N,"airport","test"')
    with open(os.path.join(root, "airport_list.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")

    raw = files.read_csv(spark, os.path.join(root, "flights"), FLIGHT_SCHEMA)
    airports = fl.load_airports(files.read_airports(spark, os.path.join(root, "airport_list.csv")))
    enriched = fl.enrich_flights(raw, airports)
    fl.write_enriched(enriched, os.path.join(root, "enriched"))
    stored = spark.read.parquet(os.path.join(root, "enriched"))
    year, month = 1996, 5
    out = fl.route_analysis(stored, year, month)

    # pandas brute force of the same month
    f = flights.toPandas()
    f["FlightDate"] = pd.to_datetime(f.FlightDate, errors="coerce")
    a = air.dropna(subset=["Latitude", "Longitude"]).set_index("IATA")
    f = f[f.Origin.isin(a.index) & f.Dest.isin(a.index)]
    f = f[(f.FlightDate.dt.year == year) & (f.FlightDate.dt.month == month)]
    assert out["total"].first()[0] == len(f)
    pairs = f.groupby(["Origin", "Dest"]).size().reset_index(name="total")
    pairs = pairs.sort_values(["total", "Origin", "Dest"], ascending=[False, True, True]).head(10)
    got = out["top_routes"].toPandas()  # already ordered: total desc, then codes
    assert got[["IATA_ORIGIN", "IATA_DEST", "total"]].values.tolist() == pairs.values.tolist()
    by_origin = f.groupby("Origin").size()
    best = by_origin[by_origin == by_origin.max()].index.min()
    assert out["top_origin"].first()["IATA_ORIGIN"] == best
    days = f.groupby(f.FlightDate.dt.date).size()
    assert [r.vuelos for r in out["daily"].collect()] == days.tolist()


def test_orders_from_files_to_consolidated_csv(spark):
    root = tempfile.mkdtemp(prefix="tessel-e2e-")
    d = SF001
    staging.write_workbooks(si.customers(spark, d), os.path.join(root, "customers"))
    sinks.write_csv(si.geolocations(spark, d).orderBy("line_no").coalesce(1),
                    os.path.join(root, "geo"))
    sinks.write_csv(si.order_items(spark, d), os.path.join(root, "items"))
    sinks.write_csv(si.orders(spark, d), os.path.join(root, "orders"))
    staging.write_json_records(si.states(spark, d), os.path.join(root, "states"))

    customers = workbook.read_workbooks(
        spark, os.path.join(root, "customers"),
        "customer_id bigint, customer_zip_code_prefix string, customer_city string")
    geo = files.read_csv(spark, os.path.join(root, "geo"),
                         "line_no bigint, geolocation_zip_code_prefix string, "
                         "geolocation_lat double, geolocation_lng double, "
                         "geolocation_city string, geolocation_state string")
    items = files.read_csv(spark, os.path.join(root, "items"),
                           "order_id bigint, order_item_id int, product_id bigint, "
                           "seller_id bigint, price double")
    orders = files.read_csv(spark, os.path.join(root, "orders"),
                            "order_id bigint, customer_id bigint, order_status string, "
                            + ", ".join(f"{c} string" for c in od.TIMESTAMP_COLUMNS))
    states = files.read_json_records(spark, os.path.join(root, "states"),
                                     "abbreviation string, state string")
    result = od.consolidate_orders(orders, items, customers, geo, states)
    sinks.write_csv(result, os.path.join(root, "out"))
    back = spark.read.option("header", True).csv(os.path.join(root, "out")).toPandas()

    o = si.orders(spark, d).toPandas()
    assert len(back) == len(o) and set(back.order_id.astype(int)) == set(o.order_id)
    it = si.order_items(spark, d).toPandas().groupby("order_id").price.agg(["count", "sum"])
    back = back.set_index(back.order_id.astype(int))
    for oid in list(it.index[:25]):
        assert int(back.loc[oid, "total_products"]) == it.loc[oid, "count"]
        assert abs(float(back.loc[oid, "total_sales"]) - it.loc[oid, "sum"]) < 1e-6
    g = si.geolocations(spark, d).toPandas().sort_values("line_no").drop_duplicates(
        "geolocation_zip_code_prefix")
    c = si.customers(spark, d).toPandas().merge(
        g, left_on="customer_zip_code_prefix", right_on="geolocation_zip_code_prefix", how="left")
    c = c.merge(si.states(spark, d).toPandas(), left_on="geolocation_state",
                right_on="abbreviation", how="left").set_index("customer_id")
    for oid, row in back.head(25).iterrows():
        want = c.loc[int(row.customer_id), "state"]
        assert (pd.isna(want) and pd.isna(row.state)) or row.state == want
