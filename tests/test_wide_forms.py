"""Binned density (AGG21), co-bucketed tables (JN5, JN6), inferred schemas (SRC1, SRC2), Newton-CG (ML3)."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import plan_of
from tessel.operators import density
from tessel.operators import evaluate as ev
from tessel.operators import ml
from tessel.operators import newton_cg as ncg
from tessel.operators import profile as pf
from tessel.plans import bucketed, catalogue
from tessel.sources import infer


@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("tolerance", [1e-2, 1e-5, 1e-9])
def test_binned_density_is_within_its_bound(spark, by, tolerance):
    r = np.random.default_rng(4)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(r.lognormal(size=600))] + [(0, None), (0, math.nan), (None, 1.0), (7, 2.0), (7, 2.0), (8, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    if by is None:
        df = df.where("g is not null")
    keyed = lambda out: {(x["g"] if by else 0, x["i"]): x for x in out.collect() if not by or x["g"] is not None}
    want, got = keyed(pf.kde(df, "v", by=by)), keyed(density.kde_binned(df, "v", by=by, tolerance=tolerance))
    assert got.keys() == want.keys() and len(got) == 200 * (3 if by else 1)
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v) and g is not None:
            groups.setdefault(g if by else 0, []).append(v)
    for k, x in got.items():
        h = np.std(groups[k[0]], ddof=1) * len(groups[k[0]]) ** -0.2
        assert abs(x["density"] - want[k]["density"]) <= 1.001 * tolerance / (h * math.sqrt(2 * math.pi)) + 1e-15
        assert x["n"] == want[k]["n"] and abs(x["x"] - want[k]["x"]) < 1e-9


def test_a_task_hands_on_fine_points_not_values(spark):
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) v")
    rows = density.kde_binned(df, "v", tolerance=1e-3)
    assert rows.count() == 200 and density.kde_binned(df.limit(0), "v").count() == 0


def test_bucketed_join_exchanges_nothing(spark):
    orders = spark.range(400).selectExpr("id order_id", "id % 7 customer_id", *[f"'2024-01-{d:02d} 00:00:00' {c}" for d, c in enumerate(
        ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"], 1)])
    items = spark.range(1500).selectExpr("id % 350 order_id", "cast(id % 4 as int) order_item_id", "cast(id as double) price")
    o, i = bucketed.store_orders(orders, items, 4)
    joined = bucketed.orders_with_totals(o, i)
    plan = plan_of(joined)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert joined.count() == 400 and joined.where("total_products is null").count() == 50
    assert joined.selectExpr("sum(total_sales)").first()[0] == sum(range(1500))


def test_type_lattice():
    T = infer
    kinds = range(5)
    for a in kinds:
        assert T.join(a, a) == a and T.join(T.EMPTY, a) == a and T.join(a, T.TEXT) == T.TEXT
        for b in kinds:
            assert T.join(a, b) == T.join(b, a)
            for c in kinds:
                assert T.join(T.join(a, b), c) == T.join(a, T.join(b, c))
    want = {"12": T.INTEGER, "-3": T.INTEGER, "0": T.INTEGER, "007": T.TEXT, "1.5": T.DECIMAL, "-.5e3": T.DECIMAL, "01.5": T.TEXT, "1" * 19: T.DECIMAL,
            "NaN": T.DECIMAL, "true": T.BOOLEAN, "False": T.BOOLEAN, "x": T.TEXT, "2024-01-01": T.TEXT, " 1": T.TEXT, None: T.EMPTY}
    assert {v: T.type_of(v) for v in want} == want


def test_prefix_decides_the_types(spark, tmp_path):
    for name, lines in (("a.csv", ["1,01234,x,,true,1", "2,99999,y,,false,2.5"]), ("b.csv", ["oops,1,z,7,maybe,3"])):
        (tmp_path / name).write_text("id,zip,city,none,flag,num\n" + "\n".join(lines) + "\n")
    got = infer.read_csv_inferred(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in got.dtypes] == ["bigint", "string", "string", "string", "boolean", "double"]
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    both = infer.read_csv_inferred(spark, paths)
    assert dict(both.dtypes)["id"] == "string" and dict(both.dtypes)["flag"] == "string"
    schema = infer.infer_schema(spark, paths[0], prefix_rows=1, text_columns=["num"])
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "string", "string", "string", "boolean", "string"]
    (tmp_path / "c.csv").write_text("id\n1\n2\nbad\n")
    late = infer.read_csv_inferred(spark, str(tmp_path / "c.csv"), prefix_rows=2)
    assert sorted((r["id"] for r in late.collect()), key=str) == [1, 2, None]
    with pytest.raises(Exception):
        infer.read_csv_inferred(spark, str(tmp_path / "c.csv"), prefix_rows=2, strict=True).collect()
    (tmp_path / "d.csv").write_text("\\N,5\n3,\\N\n")
    assert [tuple(r) for r in infer.read_csv_inferred(spark, str(tmp_path / "d.csv"), header=False, null_value="\\N").collect()] == [(None, 5), (3, None)]


def logistic(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) / math.sqrt(d)
    y = (r.random(n) < 1 / (1 + np.exp(-4 * x @ r.normal(size=d)))).astype(int)
    return x, y


def gradient(x, y, w, C):
    x = np.c_[x, np.ones(len(x))]
    return w + C * x.T @ (1 / (1 + np.exp(-(x @ w))) - y)


def test_newton_cg_on_five_hundred_features(spark):
    x, y = logistic(900, 500, 1)
    names = [f"f{i}" for i in range(500)]
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", y int").repartition(2)
    w = ncg.train_logistic_cg(df, names, "y", tol=1e-5)
    assert np.abs(gradient(x, y, w, 1.0)).max() < 1e-3 and len(w) == 501


def test_newton_cg_equals_the_formed_hessian(spark):
    x, y = logistic(300, 4, 2)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y int")
    assert np.allclose(ncg.train_logistic_cg(df, names, "y", tol=1e-9), ml.train_logistic_newton(df, names, "y"), atol=1e-5)
    assert not ncg.train_logistic_cg(df.limit(0), names, "y").any()
    with pytest.raises(Exception, match="NULL"):
        ncg.train_logistic_cg(spark.createDataFrame([(None, 1)], "a double, y int"), ["a"], "y")


def test_newton_cg_stores_small_blocks(spark):
    df = spark.range(0, 30_000, 1, 2).selectExpr("cast(id % 11 as double) a", "cast(id % 7 as double) b", "cast(id % 3 = 0 as int) y")
    data = ncg.blocks(df, ["a", "b"], "y")
    most, n = data.selectExpr("max(length(x))", "sum(rows)").first()
    assert most <= 1 << 14 and n == 30_000  # readers hold thousands of blocks at a time
    i = np.arange(30_000)
    x, y = np.c_[i % 11, i % 7, np.ones(len(i))].astype(float), (i % 3 == 0).astype(float)
    w, v = np.array([0.1, -0.2, 0.3]), np.array([1.0, 2.0, -1.0])
    assert np.allclose(ncg._summed(data, 3, ncg._loss_gradient(w))[:3], x.T @ (1 / (1 + np.exp(-x @ w)) - y))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.allclose(ncg._summed(data, 3, ncg._curvature(w, v)), x.T @ (p * (1 - p) * (x @ v)))
    wide = spark.range(3).selectExpr(*[f"cast(id + {k} as double) c{k}" for k in range(1100)], "cast(id as int) y")
    assert [r["rows"] for r in ncg.blocks(wide, [f"c{k}" for k in range(1100)], "y").collect()] == [1, 1, 1]


def test_newton_cg_reads_the_rows_once_a_step(spark, monkeypatch):
    x, y = logistic(400, 4, 3)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y int").repartition(3)
    count = dict.fromkeys(["_summed", "_step"], 0)
    for name in count:
        def counted(*a, name=name, f=getattr(ncg, name)):
            count[name] += 1
            return f(*a)
        monkeypatch.setattr(ncg, name, counted)
    w = ncg.train_logistic_cg(df, names, "y", tol=1e-9)
    assert count["_step"] > 2 and count["_summed"] == count["_step"] + 1
    assert np.abs(gradient(x, y, w, 1.0)).max() < 1e-6
    monkeypatch.setattr(ncg, "NARROW", 0)  # a pass for each product
    steps, count["_step"] = count["_step"], 0
    assert np.allclose(ncg.train_logistic_cg(df, names, "y", tol=1e-9), w, atol=1e-9) and count["_step"] == steps


def test_newton_cg_blocks_are_compressed_and_exact(spark):
    x = np.random.default_rng(4).choice([0.1, -3.7, 1e300, 5e-324, np.pi], size=(2000, 2))
    df = spark.createDataFrame([(*map(float, a), i % 2) for i, a in enumerate(x)], "a double, b double, y int").coalesce(1)
    rows = [(r["x"], r["y"]) for r in ncg.blocks(df, ["a", "b"], "y").collect()]
    assert sum(len(a) for a, _ in rows) < 2000 * 3 * 8 / 2
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["x", "y"])
    xs, ys = zip(*ncg._joined(batch, 3))
    assert sorted(map(tuple, np.c_[np.concatenate(xs), np.concatenate(ys)])) == sorted((*map(float, a), 1.0, i % 2) for i, a in enumerate(x))


def test_wide_features_are_compiled(spark, tmp_path):
    keys = [*range(-30, 60), 10 ** 12 + 7, None]
    items = [(k, n, float(i % 50), 100.0, 0.0, 0.0, "R") for i, (k, n) in enumerate((k, n) for k in keys for n in (1, 2, 7, None))]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue._wide(spark, str(tmp_path)).select(*[f"w{k}" for k in range(20)]).collect()
    want = [tuple(None if key is None or n is None or (key + k) % 13 == 0 else int(math.fmod(key * (k + 3) + n * (k * k + 1), 11 + 2 * k)) for k in range(20))
            for key, n, *_ in items]
    by = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)
    q = catalogue.q_newton_cg_gradient(spark, str(tmp_path))
    assert q.count() == 22 and q.where("abs(gradient) > 0").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # the JVM never compiles a method of more than 8000 bytes
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(q.select("*")._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(map(int, sizes)) < 7500


def test_a_thousand_classes(spark):
    df = spark.range(40_000).selectExpr("cast(id % 1000 as int) label", "cast(id * 7 % 1003 as int) prediction").union(spark.sql("select cast(null as int), 3"))
    cells = ev.confusion(df)
    assert cells.count() == 1003 * 1003 and cells.agg({"count": "sum"}).first()[0] == 40_000
    assert ev.class_report(df).count() == 1003 + 3
