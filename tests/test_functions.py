"""SC1-SC20: lenient parsing, period labels, delay classes and scalar helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessel.functions import dates, scalars


def test_parse_date_is_lenient(spark):
    df = spark.createDataFrame([("2024-03-05",), ("not a date",), (None,), ("2024-13-01",)],
                               "d string")
    got = [r[0] for r in df.select(dates.parse_date("d")).collect()]
    assert got == [dt.date(2024, 3, 5), None, None, None]


def test_parse_date_with_format(spark):
    df = spark.createDataFrame([("3/5/2024",), ("x",)], "d string")
    got = [r[0] for r in df.select(dates.parse_date("d", "M/d/yyyy")).collect()]
    assert got == [dt.date(2024, 3, 5), None]


def test_parse_timestamp_ntz_and_labels(spark):
    df = spark.createDataFrame([("2018-05-03 10:00:00",), ("garbage",), ("2018-01-31 23:59:59",)],
                               "t string")
    out = df.select(dates.parse_timestamp("t").alias("ts")).select(
        "ts", dates.year("ts").alias("y"), dates.month("ts").alias("m"),
        dates.quarter_label("ts").alias("q"), dates.month_label("ts").alias("ym"))
    assert dict(out.dtypes)["ts"] == "timestamp_ntz"
    got = out.collect()
    assert got[0]["q"] == "2018Q2" and got[0]["ym"] == "2018-05" and got[0]["y"] == 2018
    assert got[1]["ts"] is None and got[1]["q"] is None
    assert got[2]["q"] == "2018Q1" and got[2]["m"] == 1


@pytest.mark.parametrize("delta,label", [
    (0.0, "on_time"), (-1.5, "on_time"), (3.0, "short_delay"), (2.5, "short_delay"),
    (3.01, "long_delay"), (0.0001, "short_delay"), (None, "short_delay")])
def test_delay_class_thresholds(spark, delta, label):
    df = spark.createDataFrame([(delta,)], "d double")
    assert df.select(dates.delay_class("d")).first()[0] == label


def test_delay_class_missing_label(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "d double")
    got = [r[0] for r in df.select(dates.delay_class("d", missing_label="undelivered")).collect()]
    assert got == ["undelivered", "long_delay"]


def test_days_between_is_fractional_and_signed(spark):
    df = spark.createDataFrame([("2018-01-02 12:00:00", "2018-01-01 00:00:00"),
                                ("2018-01-01 00:00:00", "2018-01-04 00:00:00"),
                                (None, "2018-01-01 00:00:00")], "a string, b string")
    d = df.select(dates.days_between(dates.parse_timestamp("a"), dates.parse_timestamp("b")))
    assert [r[0] for r in d.collect()] == [1.5, -3.0, None]


def test_hex_colour_is_deterministic_and_null_safe(spark):
    df = spark.createDataFrame([("AA",), ("AA",), ("DL",), (None,)], "a string")
    got = [r[0] for r in df.select(scalars.hex_colour("a")).collect()]
    assert got[0] == got[1] and got[0] != got[2] and got[3] is None
    assert len(got[0]) == 7 and got[0].startswith("#")
    int(got[0][1:], 16)


def test_join_text_null_propagates(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None)], "a string, b string")
    assert [r[0] for r in df.select(scalars.join_text("a", "b")).collect()] == ["A → B", None]


def test_clamp_and_rounding(spark):
    df = spark.createDataFrame([(0.1, 0.125), (10.0, 0.135), (2.0, 2.5)], "x double, y double")
    out = df.select(scalars.clamp("x", 0.5, 5.0), scalars.round_half_even("y", 2)).collect()
    assert [r[0] for r in out] == [0.5, 5.0, 2.0]
    assert [r[1] for r in out] == [0.12, 0.14, 2.5]


def test_formats(spark):
    df = spark.createDataFrame([(1234567, 2.5, 2024, 3)], "n long, x double, y int, m int")
    r = df.select(scalars.thousands("n"), scalars.two_decimals("x"),
                  scalars.year_month_label("y", "m")).first()
    assert tuple(r) == ("1,234,567", "2.50", "2024-03")


def test_missing_value_helpers(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (2.0,), (None,)], "x double")
    out = df.select(scalars.zero_to_null("x").alias("z"), scalars.nan_to_null("x").alias("n"),
                    scalars.fill(scalars.zero_to_null("x"), 9.0).alias("f")).collect()
    assert out[0]["z"] is None and out[0]["f"] == 9.0
    assert out[1]["n"] is None
    assert out[2]["z"] == 2.0 and out[3]["f"] == 9.0


def test_segment_and_point(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    r = df.select(scalars.segment("a", "b", "c", "d"), scalars.point("a", "b")).first()
    assert r[0] == [[1.0, 2.0], [3.0, 4.0]] and r[1] == [1.0, 2.0]


def test_lenient_cast(spark):
    df = spark.createDataFrame([("1.5",), ("abc",)], "s string")
    assert [r[0] for r in df.select(scalars.lenient_cast("s", "double")).collect()] == [1.5, None]


def test_no_python_udf_in_expressions(spark):
    df = spark.createDataFrame([("AA", 1.0)], "a string, x double")
    out = df.select(scalars.hex_colour("a"), scalars.clamp("x", 0.5, 5.0),
                    F.lit(1).alias("one"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_custom_colour_runs_in_arrow_batches(spark):
    df = spark.createDataFrame([("AA",), (None,)], "a string")
    out = df.select(scalars.custom_colour("a", lambda k: "#" + k.lower() * 3)).collect()
    assert [r[0] for r in out] == ["#aaaaaa", None]
