"""Cases from review: hot classes, NaN, NULL classes, large integers, overflow, helper columns."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from tessel.operators import evaluate as ev
from tessel.operators import ml
from tessel.operators import profile as pf
from tessel.plans import flights as fl
from tessel.plans import orders as od
from tessel.plans import profiling
from tessel.plans import standins as si


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(0, 4000).withColumn("cls", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise((F.col("id") % 3 == 0).cast("int")))
    split = ml.stratified_split(df, "cls", 0.3, 42, key_cols=["id"], bits=4)
    n = {r["cls"]: r["n"] for r in df.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    got = {(r["cls"], r["split"]): r["n"] for r in ml.split_sizes(split, "cls").collect()}
    for c, total in n.items():
        assert got[(c, "test")] == int(total * 0.3 + 0.5) and got[(c, "train")] == total - got[(c, "test")]
    again = ml.stratified_split(df.repartition(7), "cls", 0.3, 42, key_cols=["id"], bits=12)
    assert rows(split.select("id", "split")) == rows(again.select("id", "split"))


@pytest.mark.parametrize("build", [
    lambda df: ml.stratified_split(df, "cls", 0.3, 42, key_cols=["id"]),
    lambda df: pf.histogram(df, "v", 10, by="cls", common_range=False)])
def test_a_hot_class_is_not_shuffled(spark, build):
    df = spark.range(0, 20_000).withColumns({"cls": (F.col("id") % 3 == 0).cast("int"), "v": F.rand(1)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = build(df)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_cls" not in plan
    moved = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert all("cls" not in ln or "bin" in ln for ln in moved)


def test_nan_and_null_class_are_left_out(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (nan, 0), (5.0, 1), (None, 1), (3.0, None)], "v double, c int")
    for common in (True, False):
        got = pf.histogram(df, "v", 2, by="c", common_range=common).collect()
        assert {r["c"] for r in got} == {0, 1} and sum(r["count"] for r in got) == 3
        assert all(r["bin_lo"] == r["bin_lo"] for r in got)
    d = pf.describe(df, ["v"]).first()
    assert (d["count"], d["mean"], d["max"], d["p50"]) == (4, 2.75, 5.0, 2.5)
    assert pf.describe(df, ["v"], exact=False).first()["max"] == 5.0


def test_column_profile_tells_large_integers_apart(spark):
    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,), (None,), (9007199254740993,)], "i long")
    r = pf.column_profile(df).first()
    assert (r["n_unique"], r["n_missing"]) == (2, 1)


def test_approximate_profile_has_the_same_form(spark):
    df = si.airports_wide(spark, SF001)
    exact, rough = ({r["column"]: r for r in pf.column_profile(df, exact=e).collect()} for e in (True, False))
    assert pf.column_profile(df).columns == pf.column_profile(df, exact=False).columns
    for c, r in exact.items():
        assert abs(rough[c]["n_unique"] - r["n_unique"]) <= 0.15 * r["n_unique"]
        assert (rough[c]["n_missing"], rough[c]["min"], rough[c]["max"]) == (r["n_missing"], r["min"], r["max"])


def test_auc_counts_do_not_overflow(spark):
    big = 4 * 10**9
    cum = spark.createDataFrame([(0.9, big, 0, big, 0), (0.1, 0, big, big, big)], "score double, tp long, fp long, tps long, fps long")
    old = ev.cumulative_by_score
    try:
        ev.cumulative_by_score = lambda *a: cum
        assert ev.auc(cum).first()["auc"] == 1.0
    finally:
        ev.cumulative_by_score = old


def test_correlation_of_a_constant_and_newton_without_convergence(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.5, 7.0), (3.0, 5.0, 7.0)], "a double, b double, k double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in pf.corr_matrix(df).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "a")] == 1.0
    assert abs(got[("a", "b")] - 0.9332565252573828) < 1e-9
    with pytest.raises(RuntimeError):
        ml.train_logistic_newton(df.withColumn("y", (F.col("a") > 1).cast("int")), ["a", "b"], "y", max_iter=1)


def test_consolidated_orders_hold_no_helper_column(spark):
    parts = [f(spark, SF001) for f in (si.orders, si.order_items, si.customers, si.geolocations, si.states)]
    assert "line_no" not in od.consolidate_orders(*parts).columns


def test_route_analysis_reads_the_flights_twice(spark):
    log = tempfile.mkdtemp(prefix="tessel-routes-")
    path = os.path.join(log, "enriched")
    fl.write_enriched(fl.enrich_flights(si.flights(spark, SF001), fl.load_airports(si.airports(spark, SF001))), path)
    flights = spark.read.parquet(path)
    out = fl.route_analysis(flights, 1995, 3)
    for name, table in out.items():
        text = table._jdf.queryExecution().optimizedPlan().toString()
        assert ("FlightDate" in text) == (name == "daily"), name
    assert out["label"].first()["label"] == "1995-03"
    month = fl.select_month(flights, 1995, 3)
    assert out["total"].first()["total_flights"] == month.count()
    assert rows(out["route_options"]) == rows(fl.route_options(month))
    assert rows(out["filter_options"]) == rows(fl.filter_options(flights))
    every = fl.route_analysis(flights)
    assert rows(every["top_origin"]) == rows(fl.top_airport(flights, "origin"))
    assert rows(every["routes"].select("Year", "Month", "IATA_ORIGIN", "IATA_DEST", "AIRLINE", "weight")) == rows(
        fl.route_layer(fl.route_counts(flights)).select("Year", "Month", "IATA_ORIGIN", "IATA_DEST", "AIRLINE", "weight"))
    with pytest.raises(ValueError):
        fl.route_analysis(flights, year=1995)


def test_profile_table_is_complete(spark):
    df = si.clinical(spark, SF001).select("l_quantity", "l_discount", "Outcome")
    out = profiling.profile_table(df, label="Outcome")
    assert {"describe", "info", "shape", "size", "correlation", "column_profile", "column_histograms", "density", "pair_bins", "class_histograms"} == set(out)
    assert out["class_histograms"]["l_quantity"].count() == 50 and out["density"]["l_discount"].count() == 400
    n = out["pair_bins"].groupBy("x_col", "y_col").agg(F.sum("count").alias("n")).collect()
    assert {(r["x_col"], r["y_col"]) for r in n} == {("l_quantity", "l_discount"), ("l_discount", "l_quantity")}
    assert json.dumps(sorted({r["n"] for r in n})) == json.dumps([df.count()])


def test_checkpoint_folder_is_required_off_local_mode():
    from tessel import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
