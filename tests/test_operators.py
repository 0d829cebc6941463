"""Projections, filters, joins, aggregates, ordering and de-duplication (PRJ, FLT, JN, AGG, ORD, SET)."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import plan_of, rows
from tessel.operators import aggregate as ag
from tessel.operators import clean, dedup, joins, ordering


def test_select_cast_and_positional_rename(spark):
    df = spark.createDataFrame([("1", "2.5", "x"), ("2", "bad", "y")], "a string, b string, c string")
    out = clean.select_cast(df, {"a": "bigint", "b": "double"})
    assert rows(out) == [(1, 2.5), (2, None)]
    assert clean.rename_positional(df, ["p", "q"]).columns == ["p", "q", "c"]
    assert clean.rename(df, {"a": "A", "zz": "Z"}).columns == ["A", "b", "c"]


def test_not_null_keeps_nan_and_makes_outer_join_inner(spark):
    facts = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, v int")
    dim = spark.createDataFrame([("A", 1.0), ("B", float("nan")), ("C", None)], "k string, x double")
    j = clean.not_null(joins.left_join(facts, dim, on="k"), "x")
    assert sorted(r.k for r in j.collect()) == ["A", "B"]  # NaN is not missing
    plan = plan_of(j)
    assert "LeftOuter" not in plan


def test_sentinel_text_and_optional_filters(spark):
    df = spark.createDataFrame([("\\N", "US"), (None, "US"), ("JFK", "US"), ("LHR", "UK")],
                               "iata string, country string")
    assert rows(clean.not_sentinel(df, "iata")) == [("JFK", "US"), ("LHR", "UK")]
    assert clean.where_all(df, country=None).count() == 4
    assert clean.where_all(df, country="UK", iata=None).count() == 1
    assert clean.where_text(df, "country = 'US' AND iata IS NOT NULL").count() == 2
    assert not clean.is_empty(df) and clean.is_empty(df.where("false"))


def test_left_join_null_keys(spark):
    left = spark.createDataFrame([("a", "x"), (None, "y")], "k string, l string")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k2 string, r int")
    plain = joins.left_join(left, right, left_on="k", right_on="k2")
    assert rows(plain, ["l"]) == [("a", "x", "a", 1), (None, "y", None, None)]
    safe = joins.left_join(left, right, left_on="k", right_on="k2", null_safe=True)
    assert rows(safe, ["l"]) == [("a", "x", "a", 1), (None, "y", None, 2)]
    r2 = right.withColumnRenamed("k2", "k")
    same = joins.left_join(left, r2, on="k", null_safe=True)
    assert same.columns == ["k", "l", "r"] and rows(same, ["l"]) == [("a", "x", 1), (None, "y", 2)]


def test_checked_broadcast_respects_bound(spark):
    big = spark.range(0, 2000).withColumnRenamed("id", "k")
    dim = spark.range(0, 50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    small_plan = plan_of(big.join(joins.checked_broadcast(dim, 100), "k"))
    assert "BroadcastHashJoin" in small_plan
    assert joins.checked_broadcast(dim, 10) is dim  # over the bound: no hint
    assert joins.measured(dim, 100) == (50, 50 * 32) and joins.measured(dim, 9)[0] == 10


def test_assert_unique_finds_duplicate_keys(spark):
    dim = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0)], "IATA string, lat double")
    assert [r.IATA for r in joins.assert_unique(dim, "IATA").collect()] == ["A"]


def test_group_counts_null_key_semantics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "k string, p double")
    assert rows(ag.count_rows_by(df, "k")) == [("a", 2), (None, 1)]
    assert rows(ag.count_rows_by(df, "k", drop_null_keys=True)) == [("a", 2)]
    assert rows(ag.count_and_sum_by(df, "k", "p", "p", "n", "s")) == [("a", 1, 1.0)]
    allnull = spark.createDataFrame([("a", None)], "k string, p double")
    assert rows(ag.count_and_sum_by(allnull, "k", "p", "p", "n", "s")) == [("a", 0, 0.0)]
    assert rows(ag.count_non_null_by(df, "k", "p")) == [("a", 1)]


def test_totals_metrics_and_shares(spark):
    df = spark.createDataFrame([("d1", 2.0), ("d1", 3.0), ("d2", 5.0)], "day string, v double")
    assert ag.total(df, "v").first()[0] == 10.0
    assert ag.total(df.where("false"), "v").first()[0] == 0
    m = ag.count_days_mean(df, "day").first()
    assert (m.total_flights, m.num_days, m.mean_per_day) == (3, 2, 1.5)
    empty = ag.count_days_mean(df.where("false"), "day").first()
    assert (empty.total_flights, empty.num_days, empty.mean_per_day) == (0, 0, 0.0)
    s = ag.share_of_total(df, "v").select("share").collect()
    assert sorted(r[0] for r in s) == [0.2, 0.3, 0.5]
    g = ag.share_of_total(df, "v", by="day")
    assert rows(g.select("day", "share")) == [("d1", 0.4), ("d1", 0.6), ("d2", 1.0)]
    assert [r[0] for r in ag.scale_by_max(df, "v").select("scaled").collect()] == [0.4, 0.6, 1.0]
    assert ag.column_means(df, ["v"]) == {"v": 10.0 / 3}
    assert [r[0] for r in ag.distinct_sorted(df, "day").collect()] == ["d1", "d2"]


def test_top_k_and_argmax_ties(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("d", 2)], "k string, n long")
    assert [r.k for r in ordering.top_k(df, "n", 2, ["k"]).collect()] == ["a", "b"]
    g = df.withColumn("g", F.lit(1))
    best = ordering.argmax_by_group(g, "g", "k", "n").first()
    assert (best.k, best.n) == ("a", 3)
    assert plan_of(ordering.top_k(df, "n", 2, ["k"])).count("TakeOrderedAndProject") == 1


def test_top_k_per_group_matches_pandas_with_a_hot_group(spark):
    data = [("hot", i, i % 97) for i in range(3000)] + [("cold", i, i % 7) for i in range(40)]
    df = spark.createDataFrame(data, "g string, id long, v long")
    out = ordering.top_k_per_group(df, "g", ["-v", "id"], 5, salt_buckets=8)
    pdf = pd.DataFrame(data, columns=["g", "id", "v"]).sort_values(["g", "v", "id"],
                                                                    ascending=[True, False, True])
    expect = pdf.groupby("g").head(5)
    got = out.select("g", "id", "v", "rank").orderBy("g", "rank").toPandas()
    assert got[["g", "id", "v"]].values.tolist() == expect.values.tolist()


def test_sample_n_exact_and_repeatable(spark):
    df = spark.range(0, 1000).withColumn("x", F.col("id") * 3)
    a = [r.id for r in ordering.sample_n(df, 17, seed=7).collect()]
    b = [r.id for r in ordering.sample_n(df.repartition(13), 17, seed=7).collect()]
    c = [r.id for r in ordering.sample_n(df, 17, seed=8).collect()]
    assert len(a) == 17 and sorted(a) == sorted(b) and sorted(a) != sorted(c)
    assert ordering.sample_n(df.limit(5), 17).count() == 5


def test_sort_and_head(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n int, s string")
    assert [r.n for r in ordering.sort(df, "-n").collect()] == [3, 2, 1]
    assert [r.n for r in ordering.head(df, 2, ["n"]).collect()] == [1, 2]


def test_first_per_key_follows_order_column(spark):
    df = spark.createDataFrame([("01001", 3, "SP"), ("01001", 1, "RJ"), ("01001", 2, "MG"),
                                ("02002", 5, "BA"), (None, 9, "XX"), (None, 8, "YY")],
                               "zip string, line_no long, state string")
    out = dedup.first_per_key(df, "zip", "line_no")
    assert rows(out) == [("01001", 1, "RJ"), ("02002", 5, "BA"), (None, 8, "YY")]
    again = dedup.first_per_key(df.repartition(5), "zip", "line_no")
    assert rows(again) == rows(out)


def test_one_per_key_and_union(spark):
    a = spark.createDataFrame([("X", 2.0), ("X", 1.0)], "k string, v double")
    b = spark.createDataFrame([("Y", 5.0)], "k string, v double")
    u = dedup.union_all(a, b)
    assert u.count() == 3
    assert rows(dedup.one_per_key(u, "k")) == [("X", 1.0), ("Y", 5.0)]
    assert rows(dedup.distinct_values(u, "k")) == [("X",), ("Y",)]


def test_sample_n_md5_is_engine_independent(spark):
    import duckdb

    df = spark.range(0, 300).withColumnRenamed("id", "k")
    got = [r.k for r in ordering.sample_n(df, 7, seed=3, key_cols=["k"], hash="md5").collect()]
    want = [r[0] for r in duckdb.sql("SELECT range AS k FROM range(300) "
                                     "ORDER BY md5('3|' || CAST(range AS VARCHAR)), k "
                                     "LIMIT 7").fetchall()]
    assert sorted(got) == sorted(want)


def test_approx_distinct_days(spark):
    df = spark.range(0, 5000).withColumn("day", (F.col("id") % 365).cast("string"))
    exact = ag.count_days_mean(df, "day").first()
    approx = ag.count_days_mean(df, "day", approx=True).first()
    assert exact.num_days == 365 and abs(approx.num_days - 365) <= 15


def test_number_against_text_key_compares_as_text(spark):
    df = spark.createDataFrame([("24220", 1), ("0A1", 2), ("024220", 3)], "zip string, v int")
    assert [r.v for r in clean.where_all(df, zip=24220).collect()] == [1]


def test_sample_is_exact_for_every_size_and_hash(spark):
    df = spark.range(0, 3000).withColumn("x", F.col("id") % 3)
    small = {r.id for r in ordering.sample_n(df, 10, seed=5).collect()}
    assert ordering.sample_n(df, 1234, seed=5, hash="md5", bits=3).distinct().count() == 1234
    for n, bits in [(700, 4), (700, 16), (11, 1), (2999, 8), (5000, 8)]:
        got = [r.id for r in ordering.sample_n(df.repartition(4), n, seed=5, bits=bits).collect()]
        want = sorted(r.id for r in ordering.sample_n(df, n, seed=5, bits=bits).collect())
        assert len(got) == min(n, 3000) and len(set(got)) == len(got)
        assert sorted(got) == want
    big = {r.id for r in ordering.sample_n(df, 700, seed=5, bits=6).collect()}
    assert small <= big  # the same ranking: a larger sample contains the smaller one


def test_pivot_wide_correlation_and_confusion(spark):
    from tessel.operators import evaluate as ev
    from tessel.operators import profile as pf

    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0)], "a double, b double")
    wide = clean.pivot_wide(pf.corr_matrix(df), "col_a", "col_b", "corr", ["a", "b"])
    got = {r.col_a: (r.a, r.b) for r in wide.collect()}
    assert got["a"][0] == 1.0 and got["a"][1] == got["b"][0]
    cm = ev.confusion(spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "label int, prediction int"))
    wcm = rows(clean.pivot_wide(cm, "label", "prediction", "count", [0, 1]), ["label"])
    assert wcm == [(0, 1, 0), (1, 1, 1)]


def test_broadcast_bound_shrinks_with_row_width(spark):
    narrow = spark.range(0, 100)
    wide = spark.range(0, 100).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(50)])
    budget = joins.measured(wide, 1000)[1] - 1
    assert joins.checked_broadcast(wide, 10_000, budget) is wide
    assert joins.checked_broadcast(narrow, 10_000, budget) is not narrow
    long_text = spark.range(0, 20).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert joins.checked_broadcast(long_text, max_bytes=10_000_000) is long_text


def test_left_join_rejects_ambiguous_columns(spark):
    import pytest

    left = spark.createDataFrame([("a", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 2)], "k2 string, v int")
    with pytest.raises(ValueError):
        joins.left_join(left, right, left_on="k", right_on="k2")
