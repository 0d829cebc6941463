"""Stored sketches (AGG9-AGG11, AGG14) and heavy hitters (AGG24)."""

import collections

import numpy as np
import pytest

from conftest import plan_of
from tessel.operators import profile as pf
from tessel.operators import quantiles as qt
from tessel.operators import sketches as sk


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.range(60_000).selectExpr("cast(id % 12 as int) m", "id % 5000 d", "cast(hash(id) % 1000 as double) / 7 x", "if(id % 9 = 0, null, cast(id as double)) y")
    path = str(tmp_path_factory.mktemp("s") / "t")
    sk.partition_sketches(rows, "m", ["d"], ["x", "y"]).write.partitionBy("m").parquet(path)
    return rows, spark.read.parquet(path)


def test_distinct_counts_of_any_selection(stored):
    rows, table = stored
    for where in ("true", "m in (2, 3)", "m = 5", "m > 100"):
        r = sk.distinct_counts(table.where(where), "d").first()
        n, d = rows.where(where).selectExpr("count(*)", "count(distinct d)").first()
        assert r["rows"] == n and abs(r["distinct"] - d) <= max(1, 0.016 * d)  # four standard errors
        assert r["per_distinct"] == (n / r["distinct"] if d else 0.0)
    assert sk.distinct_counts(table, "d", "m").count() == 12


def test_many_distinct_values_stay_in_bound(spark):
    df = spark.range(300_000).selectExpr("id % 7 k", "id d")
    r = sk.distinct_counts(sk.partition_sketches(df, "k", ["d"]), "d").first()
    assert abs(r["distinct"] / 300_000 - 1) < 0.016


def test_no_rescan_of_the_rows(stored):
    plan = plan_of(sk.distinct_counts(stored[1].where("m = 3"), "d"))
    assert plan.count("FileScan") == 1 and "hll_d" in plan and "PartitionFilters: [isnotnull(m" in plan


def test_quantile_ranks_against_exact_quantiles(stored):
    rows, table = stored
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for where in ("true", "m < 4"):
        part = rows.where(where)
        exact = {(r["column"], r["p"]): r["quantile"] for r in qt.exact_quantiles(part, ["x", "y"], probs).collect()}
        for r in sk.quantiles(table.where(where), ["x", "y"], probs).collect():
            values = np.sort([v[0] for v in part.where(f"{r['column']} is not null").select(r["column"]).collect()])
            assert r["n"] == len(values)
            low, high = np.searchsorted(values, r["quantile"], "left") / len(values), np.searchsorted(values, r["quantile"], "right") / len(values)
            assert low - 0.01 <= r["p"] <= high + 0.01
            if r["p"] in (0.0, 1.0):
                assert r["quantile"] == exact[r["column"], r["p"]]
    assert sk.quantiles(table.where("m > 100"), "x", probs).count() == 0


@pytest.mark.parametrize("counters, candidates", [(1000, 4000), (5, 4), (3, 1000), (1, 1)])
def test_heavy_hitters_equal_exact_counts(spark, counters, candidates):
    r = np.random.default_rng(counters)
    rows = [(None if r.random() < 0.1 else f"v{min(int(r.zipf(1.5)), 500)}", f"u{i}", None, "one") for i in range(3000)]
    df = spark.createDataFrame(rows, "`a.b` string, u string, n string, o string").repartition(4)
    got = collections.defaultdict(list)
    for x in sorted(sk.heavy_hitters(df, df.columns, 3, counters, candidates).collect(), key=lambda x: x["rank"]):
        got[x["column"]].append((x["value"], x["count"]))
    for i, c in enumerate(df.columns):
        counts = collections.Counter(x[i] for x in rows if x[i] is not None)
        assert got.get(c, []) == sorted(counts.items(), key=lambda z: (-z[1], z[0]))[:3]


def test_approximate_profile_has_the_exact_top_values(spark):
    rows = [(f"v{i % 7 % 4}", "only", i) for i in range(200)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, n int").repartition(3)
    cols = ["column", "top1", "top1_count", "top2", "top2_count", "others_count", "n_missing", "min", "max"]
    exact, rough = (sorted(map(tuple, pf.column_profile(df, exact=e).select(cols).collect())) for e in (True, False))
    assert exact == rough
