"""Physical-plan checks: pruning, pushdown, partition pruning, join strategy, no Python."""

import os
import tempfile

from conftest import SF001, plan_of
from tessel.plans import catalogue as C
from tessel.plans import flights as fl
from tessel.plans import standins as si


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_count_top_k_reads_only_needed_columns_and_uses_a_heap(spark):
    df = C.q_count_top_k(spark, SF001)
    text = _formatted(df)
    schemas = [ln for ln in text.splitlines() if "ReadSchema" in ln]
    assert len(schemas) == 1  # the staged flight records, two of their seven columns
    assert "FlightDate" in schemas[0] and "OriginStateName" in schemas[0]
    assert "Distance" not in schemas[0] and "Reporting_Airline" not in schemas[0]
    assert "TakeOrderedAndProject" in plan_of(df)


def test_enrichment_pushes_join_key_filters_to_the_scan(spark):
    text = _formatted(C.q_enrich_flights(spark, SF001))
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln]
    assert any("IsNotNull(Origin)" in ln and "IsNotNull(Dest)" in ln for ln in pushed)
    schemas = [ln for ln in text.splitlines() if "ReadSchema" in ln and "Origin" in ln]
    assert all("Distance" not in ln and "OriginStateName" not in ln for ln in schemas)


def test_month_selection_prunes_partitions(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tessel-plan-"), "enriched")
    enriched = fl.enrich_flights(si.flights(spark, SF001), fl.load_airports(si.airports(spark, SF001)))
    fl.write_enriched(enriched, path)
    stored = spark.read.parquet(path)
    one = fl.select_month(stored, 1997, 3)
    text = _formatted(one)
    assert "PartitionFilters" in text and "isnotnull(Year" in text
    assert one.count() == enriched.where("Year = 1997 AND Month = 3").count()


def test_hot_paths_have_no_python(spark):
    for q in (C.q_route_layer, C.q_consolidate_orders, C.q_describe, C.q_roc_points,
              C.q_stratified_split_sizes, C.q_kde):
        plan = plan_of(q(spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, q.__name__


def test_dimension_joins_are_broadcast(spark):
    plan = plan_of(C.q_consolidate_orders(spark, SF001))
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
