"""W1-W3 and W5 jobs on inline fixtures (FIXTURES.md) and on the test tables."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, plan_of, rows
from tessel.plans import flights as fl
from tessel.plans import orders as od
from tessel.plans import standins as si

FLIGHTS = [
    # FlightDate, Reporting_Airline, Origin, Dest
    ("2024-01-05", "AA", "JFK", "LAX"),
    ("2024-01-05", "AA", "JFK", "LAX"),
    ("2024-01-06", "DL", "LAX", "JFK"),
    ("2024-01-07", "DL", "JFK", "ORD"),
    ("2024-02-01", "AA", "ORD", "JFK"),
    ("not-a-date", "AA", "JFK", "LAX"),      # unparsable date
    (None, "AA", "JFK", "LAX"),              # null date
    ("2024-01-08", "UA", "XXX", "LAX"),      # origin missing from airports
    ("2024-01-08", "UA", "JFK", "NOC"),      # destination without coordinates
    ("2024-01-09", "UA", "LAX", "JFK"),      # tie with DL's LAX-JFK count in January
]
AIRPORTS = [("JFK", "40.64", "-73.78"), ("LAX", "33.94", "-118.41"), ("ORD", "41.97", "-87.91"),
            ("NOC", None, None), (None, "1.0", "1.0"), ("BAD", "north", "1.0")]


@pytest.fixture()
def enriched(spark):
    flights = spark.createDataFrame(FLIGHTS, "FlightDate string, Reporting_Airline string, "
                                             "Origin string, Dest string")
    airports = spark.createDataFrame(AIRPORTS, "IATA string, Latitude string, Longitude string")
    return fl.enrich_flights(flights, fl.load_airports(airports))


def test_enrichment_drops_bad_rows_and_plans_inner_broadcast_joins(enriched):
    got = enriched.toPandas()
    assert len(got) == 6
    assert list(got.columns) == fl.ENRICHED_COLUMNS
    assert set(got.IATA_ORIGIN) == {"JFK", "LAX", "ORD"} and "NOC" not in set(got.IATA_DEST)
    assert got.FlightDate.min() == dt.date(2024, 1, 5)
    plan = plan_of(enriched)
    assert plan.count("BroadcastHashJoin") == 2 and "LeftOuter" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_metrics(enriched):
    m = fl.flight_metrics(enriched).first()
    assert (m.total_flights, m.num_days, m.mean_per_day) == (6, 5, 1.2)
    t = fl.flight_metrics_text(enriched).first()
    assert (t.total_flights, t.mean_per_day, t.num_days) == ("6", "1.20", "5")


def test_route_analysis_one_month_matches_pandas(enriched):
    out = fl.route_analysis(enriched, 2024, 1)
    pdf = enriched.toPandas()
    jan = pdf[(pdf.Year == 2024) & (pdf.Month == 1)]
    routes = out["routes"].toPandas()
    want = jan.groupby(fl.ROUTE_KEYS).size()
    assert sorted(routes.total.tolist()) == sorted(want.tolist())
    assert routes.weight.max() == 4.0 and routes.weight.min() >= 0.5
    assert all(len(p) == 2 for p in routes.path)
    assert out["top_origin"].first()["IATA_ORIGIN"] == "JFK"
    # JFK and LAX are both destinations twice in January: the tie goes to the smaller code
    assert out["top_dest"].first()["IATA_DEST"] == "JFK"
    top = out["top_routes"].toPandas()
    assert top.iloc[0].Ruta == "JFK → LAX" and top.iloc[0].total == 2
    share = {r.AIRLINE: r.share for r in out["carrier_share"].collect()}
    assert share == pytest.approx({"AA": 2 / 5, "DL": 2 / 5, "UA": 1 / 5})
    daily = [r.vuelos for r in out["daily"].collect()]
    assert daily == [2, 1, 1, 1]
    markers = {r.IATA for r in out["markers"].collect()}
    assert markers == {"JFK", "LAX", "ORD"}
    assert out["total"].first()[0] == 5


def test_route_analysis_all_months_and_options(enriched):
    out = fl.route_analysis(enriched)
    tops = rows(out["top_origin"].select("Year", "Month", "IATA_ORIGIN"))
    assert tops == [(2024, 1, "JFK"), (2024, 2, "ORD")]
    opts = rows(fl.filter_options(enriched))
    assert opts == [("month", "1"), ("month", "2"), ("year", "2024")]
    ro = fl.route_options(enriched).where("Month = 2").collect()
    assert {(r.kind, r.value) for r in ro} == {("origin", "ORD"), ("dest", "JFK")}
    only_jfk = fl.select_month(enriched, 2024, 1, origin="JFK")
    assert only_jfk.count() == 3


def test_count_top_k_ties_by_key(spark):
    df = spark.createDataFrame([("d1", "S1"), ("d1", "S1"), ("d2", "S2"), ("d2", "S2"),
                                ("d0", "S9")], "FlightDate string, OriginStateName string")
    got = rows(fl.count_top_k(df, k=2), None)
    assert sorted(got) == [("d1", "S1", 2), ("d2", "S2", 2)]
    assert "TakeOrderedAndProject" in plan_of(fl.count_top_k(df, k=2))


ORDERS = [
    # id, customer, purchase, delivered, estimated
    (1, 10, "2018-02-01 10:00:00", "2018-02-10 00:00:00", "2018-02-10 00:00:00"),  # 0 days
    (2, 10, "2018-05-01 00:00:00", "2018-05-13 00:00:00", "2018-05-10 00:00:00"),  # 3 days
    (3, 11, "2018-05-02 00:00:00", "2018-05-08 12:00:00", "2018-05-10 00:00:00"),  # -1.5
    (4, 12, "2018-07-01 00:00:00", "2018-07-12 12:00:00", "2018-07-10 00:00:00"),  # 2.5
    (5, 13, "2018-07-02 00:00:00", None, "2018-07-10 00:00:00"),                   # undelivered
    (6, 99, "bad timestamp", "2018-07-11 00:14:24", "2018-07-08 00:00:00"),       # 3.01
]


def _shop(spark):
    cols = ["order_id", "customer_id", "order_purchase_timestamp",
            "order_delivered_customer_date", "order_estimated_delivery_date"]
    orders = spark.createDataFrame(ORDERS, "order_id long, customer_id long, a string, b string, "
                                           "c string").toDF(*cols)
    items = spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.5), (2, 1, 3.0), (None, 1, 7.0)],
                                  "order_id long, order_item_id int, price double")
    customers = spark.createDataFrame([(10, "01001"), (11, "02002"), (12, "99999"), (13, "03003")],
                                      "customer_id long, customer_zip_code_prefix string")
    geo = spark.createDataFrame([(1, "01001", "SP"), (0, "01001", "RJ"), (2, "02002", None),
                                 (3, "03003", "MG")],
                                "line_no long, geolocation_zip_code_prefix string, "
                                "geolocation_state string")
    states = spark.createDataFrame([("RJ", "Rio de Janeiro"), ("SP", "Sao Paulo"),
                                    (None, "Unknown")], "abbreviation string, state string")
    return orders, items, customers, geo, states


def test_consolidate_orders_semantics(spark):
    orders, items, customers, geo, states = _shop(spark)
    out = od.consolidate_orders(orders, items, customers, geo, states).toPandas()
    out = out.set_index("order_id")
    assert out.loc[1, "total_products"] == 2 and out.loc[1, "total_sales"] == 15.5
    assert pd.isna(out.loc[3, "total_products"])            # order without items
    assert out.loc[1, "delay_status"] == "on_time"           # exactly 0 days
    assert out.loc[2, "delay_status"] == "short_delay"       # exactly 3 days
    assert out.loc[3, "delta_days"] == -1.5 and out.loc[3, "delay_status"] == "on_time"
    assert out.loc[4, "delta_days"] == 2.5 and out.loc[4, "delay_status"] == "short_delay"
    assert pd.isna(out.loc[5, "delta_days"]) and out.loc[5, "delay_status"] == "short_delay"
    assert out.loc[6, "delta_days"] == pytest.approx(3.01) and out.loc[6, "delay_status"] == "long_delay"
    assert pd.isna(out.loc[6, "order_purchase_timestamp"]) and pd.isna(out.loc[6, "quarter"])
    assert out.loc[1, "quarter"] == "2018Q1" and out.loc[2, "year_month"] == "2018-05"
    # first geolocation row per zip (line 0 -> RJ), text zip keeps its leading zero
    assert out.loc[1, "geolocation_state"] == "RJ" and out.loc[1, "state"] == "Rio de Janeiro"
    assert out.loc[1, "customer_zip_code_prefix"] == "01001"
    # NULL state matches nothing by default ...
    assert pd.isna(out.loc[3, "state"])
    assert pd.isna(out.loc[4, "geolocation_state"])          # unknown zip
    assert len(out) == 6


def test_null_safe_state_join_matches_pandas_merge(spark):
    orders, items, customers, geo, states = _shop(spark)
    cg = od.customers_with_state(customers, od.unique_geolocations(geo), states, null_safe=True)
    got = {r.customer_id: r.state for r in cg.collect()}
    # pandas keeps the first row in file order; sort by line_no to model file order
    pg = geo.toPandas().sort_values("line_no").drop_duplicates("geolocation_zip_code_prefix")
    pc = customers.toPandas().merge(pg, left_on="customer_zip_code_prefix",
                                    right_on="geolocation_zip_code_prefix", how="left")
    pc = pc.merge(states.toPandas(), left_on="geolocation_state", right_on="abbreviation",
                  how="left")
    want = dict(zip(pc.customer_id, pc.state))
    assert got[11] == "Unknown" and got == {k: (None if pd.isna(v) else v) for k, v in want.items()}


def test_order_jobs_on_test_tables(spark):
    o = od.order_delay(od.order_dates(si.orders(spark, SF001)))
    counts = {r.delay_status: r["count"] for r in o.groupBy("delay_status").count().collect()}
    assert sum(counts.values()) == 1500 and set(counts) <= {"on_time", "short_delay", "long_delay"}
    items = od.item_totals(si.order_items(spark, SF001))
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert items.select(F.sum("total_products")).first()[0] == li.count()
