"""Orders and items stored in buckets of one key (JN5, JN6).

Both tables are written once, bucketed and sorted by ``order_id`` into the same number of buckets.
The per-order item totals and their join with the orders then read bucket by bucket: neither the
aggregate nor the join exchanges rows, in this job or in any later one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessel.operators import joins
from tessel.plans import orders as od
from tessel.session import shared_dir

KEY = "order_id"


def store(df: DataFrame, name: str, buckets: int, key: str = KEY, path: str | None = None) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key``, one file a bucket; the table read back.

    Choose ``buckets`` so that a bucket fits a task (some hundred megabytes); tables that are joined
    need the same number.  A key with many rows stays in one bucket: bucket by keys of bounded
    groups, as an order's items are."""
    spark = df.sparkSession
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path or shared_dir(spark, name)).saveAsTable(name))
    return spark.table(name)


def store_orders(orders: DataFrame, items: DataFrame, buckets: int = 16, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders and items as bucketed tables named ``<prefix>_orders`` and ``<prefix>_items``."""
    prefix = prefix or f"shop_{uuid.uuid4().hex[:12]}"
    return store(orders, f"{prefix}_orders", buckets), store(items, f"{prefix}_items", buckets)


def orders_with_totals(orders: DataFrame, items: DataFrame, timestamp_format: str | None = None, missing_label: str | None = None) -> DataFrame:
    """JN5: dated orders with delay and item totals, of tables from :func:`store_orders`.  The merge
    join is asked for, since its sides are already placed and sorted."""
    prepared = od.order_delay(od.order_dates(orders, timestamp_format), missing_label=missing_label)
    return joins.left_join(prepared, od.item_totals(items).hint("merge"), on=KEY, broadcast_max_rows=None)
